"""What holds row by row, or whatever else is in a batch or a table."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_llm import WORDS, table

from codeloom.llm import decontam, langid, minhash, packing, sharding


def test_clean_rows_of_dirty_ids_stay(spark):
    rnd = random.Random(7)
    passage = " ".join(rnd.choice(WORDS) for _ in range(40))
    other = lambda k: " ".join(rnd.choice(WORDS) for _ in range(30)) + f" {k}"
    rows = [(None, passage), (None, other(1)), (1, "see " + passage), (1, other(2)), (1, other(2)), (2, other(3)), (2, passage.upper()), (3, None), (3, passage)]
    bench = spark.createDataFrame([(0, passage)], "item_id long, text string")
    got = decontam.decontaminate(table(spark, rows), bench)
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted((str(i), t or "") for k, (i, t) in enumerate(rows) if k in (1, 3, 4, 5, 7))
    assert "Python" not in got._jdf.queryExecution().toString()


def test_rows_of_one_id_go_by_themselves(spark):
    rnd = random.Random(8)
    text = lambda: " ".join(rnd.choice(WORDS) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (2, a), (2, b), (3, b + " end"), (None, a), (4, c), (4, c), (5, None)]
    got = sorted((str(r.doc_id), r.text or "") for r in minhash.keep_first(table(spark, rows)).collect())
    assert got == sorted([("1", a), ("2", b), ("None", a), ("4", c), ("4", c), ("5", "")])


def test_curve_keys_do_not_depend_on_batches():
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(400))).encode() for _ in range(64 * 3)]
    keys = [np.concatenate([packing.hilbert_keys(packing.project(texts[a : a + n], 4, 10), 10) for a in range(0, len(texts), n)]) for n in (1, 7, 64)]
    assert (keys[0] == keys[1]).all() and (keys[0] == keys[2]).all() and len(set(keys[0].tolist())) > 100


def test_no_language_is_left_out(spark):
    rnd = random.Random(10)
    words = {f"l{k:02}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 8))) for _ in range(25)] for k in range(40)}
    rows = [(k * 100 + j, " ".join(rnd.choice(own) for _ in range(60)), lang) for k, (lang, own) in enumerate(words.items()) for j in range(6 + (k == 0) * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for total in (512 << 20, 40_000):
        models = langid.train(docs.filter(langid.learnable()), total_bytes=total)
        assert len(models.langs) == 40
    got = langid.identify(docs.select("doc_id", "text"), langid.train(docs.filter(langid.learnable()))).collect()
    want = {d: lang for d, _, lang in rows}
    assert {r.lang_pred for r in got} == set(words)
    assert np.mean([r.lang_pred == want[r.doc_id] for r in got]) > 0.95


def test_a_very_large_group_of_small_rows(spark):
    """Many rows without a text: shards stay near equal, and no group of equal texts is cut that fits."""
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 60))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts * 2)] + [(1000 + k, None) for k in range(700)]
    docs = table(spark, rows).repartition(3).unionByName(table(spark, []).limit(0)).cache()
    lots = docs.unionByName(spark.range(5000, 305_000).join(docs.filter("doc_id = 1000").drop("doc_id")).withColumnRenamed("id", "doc_id").select(*docs.columns))
    out = sharding.shard_by_bytes(lots)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = out.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()
    sizes = [r.bytes for r in got]
    assert sum(r.n for r in got) == 301_300 and len(got) == 16
    assert all(r.lo == 0 and r.hi == r.n - 1 for r in got) and max(sizes) - min(sizes) < 0.03 * max(sizes)
    whole = out.filter("size > 1").groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("n")).agg(F.max("n")).first()[0]
    assert whole == 1


def test_pieces_that_came_again_stay_in_a_full_memo():
    from codeloom.llm.common import Encoder, encoder, forget_encoders

    plain, small = Encoder("word_bpe_49k.json"), Encoder("word_bpe_49k.json", memo_pieces=300)
    texts = [" ".join(["common", "words", "here", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(26))]).encode() for k in range(60)]
    learnt, learn = [], small._learn_all
    small._learn_all = lambda pieces: learnt.extend(pieces) or learn(pieces)
    for t in texts:
        assert small.encode([t]) == plain.encode([t])
    assert len(small.memo) < 600 and learnt.count(b" words") == learnt.count(b" here") == 1
    encoder("word_bpe_49k.json")
    forget_encoders()
    assert encoder.cache_info().currsize == 0


def test_sets_of_a_group_are_arrays():
    import numpy as np
    import pyarrow as pa

    from codeloom.llm.minhash import _groups

    b = pa.RecordBatch.from_pydict({"k": [1, 1, 2], "set": [[5, 6], [], [7]]}, schema=pa.schema([("k", pa.int64()), ("set", pa.list_(pa.int64()))]))
    got = [(key, [v.tolist() for v in sets]) for key, (sets,) in _groups([b.slice(0, 1), b.slice(1)], ["k"], ["set"])]
    assert got == [((1,), [[5, 6], []]), ((2,), [[7]])]
    assert all(isinstance(v, np.ndarray) for _, (sets,) in _groups([b], ["k"], ["set"]) for v in sets)
