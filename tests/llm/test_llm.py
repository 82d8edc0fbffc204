"""The training-data operators against brute force, on small tables with odd rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from codeloom.llm import components, decontam, langid, line_dedup, media, minhash, packing, queries, sharding, simple8b, substring, token_io, toxicity
from codeloom.llm.common import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, th string, key string, _part int, bucket long, a long, _kept string, kept string, _doc long, doc long, _th long, _gone long, gone long, _dirty long, dirty long, _row long, lang_pred string, score double, digest string, shard int, words string, at int, line string, place string, h1 long"
WORDS = [f"{a}{b}" for a in "bdfklmnprst" for b in ("a", "e", "io", "un", "or")]


def table(spark, rows):
    """Documents with further columns of the names that the operators use themselves."""
    odd = ("x", "x", "x", 1, 2, 3, "x", "x", 4, 5, 6, 7, 8, 9, 10, 11, "x", 0.5, "x", 12, "x", 13, "x", "x", 14)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *odd) for i, t in rows], SCHEMA)


def odd_rows():
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    lines = "\n".join(text(8) for _ in range(6))
    typo = lines.split("\n")[2]
    return [
        (5, base), (3, base), (9, base), (4, " ".join(near)), (7, text(90) + " " + " ".join(base.split()[20:90]) + " " + text(10)),
        (1, None), (2, ""), (6, "  \n\t"), (8, "word"), (10, "two words"), (11, "TWO words"), (12, lines), (13, lines + "\n\n" + typo[:4] + "xx" + typo[4:]),
        (14, typo + "q\n" + typo), (15, text(9000)), (16, "a a a a a a " * 30), (17, "a a a a a a " * 30), (18, "été naïve — 中文 字\r\n\tx 3.5, a.. b"), (18, "été naïve — 中文 字\r\n\tx 3.5, a.. b"), (None, base), (None, lines),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, odd_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def groups_of(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                up[max(root(x), root(y))] = min(root(x), root(y))
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(docs, none):
    want = groups_of(odd_rows())
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.keep_first(docs).columns == docs.columns


@pytest.mark.parametrize("block", [512, 16])
def test_near_duplicates_of_a_large_family(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd = random.Random(1)
    base = [rnd.choice(WORDS) for _ in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(80)] = f"w{rnd.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    want = groups_of(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows)).collect()} == want


def test_super_minhash_estimates_similarity():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 1 << 63, 900).astype(np.uint64)
    for common in (0, 300, 600, 900):
        y = np.concatenate((x[:common], rnd.integers(0, 1 << 63, 900 - common).astype(np.uint64)))
        p, q = minhash.super_minhash(x, 256), minhash.super_minhash(y, 256)
        assert abs((p == q).mean() - common / (1800 - common)) < 0.1
    few = minhash.super_minhash(x[:3], 64)
    assert np.isfinite(few).all() and len(np.unique(few)) == 64 and minhash.super_minhash(x[:0], 4).max() == np.inf


@pytest.mark.parametrize("per_task", [1_000_000, 40])
def test_components_of_a_chain(spark, monkeypatch, per_task):
    monkeypatch.setattr(components, "TASK_LINKS", per_task)
    n = 300
    links = spark.range(1, n).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v")).repartition(16, "u")
    assert components.components(links).agg(F.count("*"), F.max("component")).first() == (n, 0)
    assert components.components(links.limit(0)).count() == 0


def test_substring_dedup(docs, none, monkeypatch):
    rows = [(i, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for i, t in odd_rows()]
    first = {}
    for i, w in rows:
        for p in range(len(w) - 49):
            if i is not None:
                k = tuple(w[p : p + 50])
                first[k] = min(first.get(k, i), i)
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    for hot in (512, 1):
        monkeypatch.setattr(substring, "HOT", hot)
        assert sorted(map(tuple, substring.remove_repeats(docs).drop("kept").collect()), key=repr) == sorted(want, key=repr)
    assert substring.remove_repeats(none).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_and_probes():
    rnd = random.Random(0)
    for _ in range(3000):
        k = rnd.choice((1, 2, 3))
        a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(12)))
        b = "".join(rnd.choice("abc") if rnd.random() < 0.2 else c for c in a)[rnd.randrange(2) :] + rnd.choice(("", "a", "bc"))
        near = distance(a, b) <= k
        assert line_dedup.within(a, b, k) is near
        short, long_ = sorted((a, b), key=len)
        if near and len(short) > k:
            index = {(len(short) * 16 + i, short[p : p + n]) for i, (p, n) in enumerate(line_dedup.segments(len(short), k))}
            assert index & {(s, long_[x:y]) for s, x, y in line_dedup.probes(len(long_), k)}


def test_line_dedup(docs, none):
    rows = [(i, t) for i, t in odd_rows() if i is not None]
    first = {}
    for i, t in sorted({(i, t or "") for i, t in rows}):
        for at, line in enumerate(t.split("\n")):
            if line.strip(" \t\r"):
                first.setdefault(line, (i, at))
    late = {x for x in first for y in first if x != y and min(len(x), len(y)) >= 16 and abs(len(x) - len(y)) < 3 and first[y] < first[x] and distance(x, y) <= 2}
    assert late
    for r in line_dedup.dedup_lines(docs).collect():
        texts = [t or "" for i, t in odd_rows() if i == r.doc_id]
        kept = {"\n".join(x for at, x in enumerate(t.split("\n")) if r.doc_id is None or not x.strip(" \t\r") or (first[x] == (r.doc_id, at) and x not in late)) for t in texts}
        assert bytes(r.kept).decode() in kept
    assert sorted(map(tuple, line_dedup.dedup_lines(docs, hot_rows=2).drop("kept").collect()), key=repr) == sorted(map(tuple, line_dedup.dedup_lines(docs).drop("kept").collect()), key=repr)
    out = line_dedup.without_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and out.filter("text IS NULL").count() == 1
    assert line_dedup.dedup_lines(none).count() == 0


@pytest.mark.parametrize("block, hot_rows", [(1024, 64), (3, 2)])
def test_links_of_a_family_of_lines(spark, monkeypatch, block, hot_rows):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rnd = random.Random(6)
    base = "the quick brown fox jumps over the lazy dog"
    made = {base}
    while len(made) < 40:
        line = list(base)
        for _ in range(rnd.randrange(1, 3)):
            at = rnd.randrange(len(line))
            line[at : at + rnd.randrange(2)] = rnd.choice(("", "x", "yz"))
        made.add("".join(line))
    lines = sorted(made, key=lambda x: hash((x, 1)) if x != base else 0) + ["aaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "\u00e9" * 20, "\u00e9" * 22]
    want = {i: sum(distance(x, y) <= 2 for j, y in enumerate(lines) if i != j) for i, x in enumerate(lines)}
    late = {i for i, x in enumerate(lines) if any(distance(x, y) <= 2 for y in lines[:i])}
    got = line_dedup.dedup_lines(table(spark, list(enumerate(lines))).repartition(5), hot_rows=hot_rows).collect()
    assert {r.doc_id: r.n_links for r in got} == want and {r.doc_id for r in got if r.n_removed} == late


def test_decontamination(spark, docs, none, monkeypatch):
    rnd = random.Random(5)
    item = [rnd.choice(WORDS) for _ in range(30)]
    changed = list(item)
    changed[6], changed[13], changed[20] = "x", "y", "z"
    half = [w if k % 2 else "q" for k, w in enumerate(item)]
    rows = [(1, "intro " + " ".join(item) + " end"), (2, ("noise " * 40) + " ".join(changed)), (3, " ".join(half)), (4, " ".join(item[:9])), (5, "Short, item!"), (6, None), (1, "short item"), (None, " ".join(item))]
    bench = spark.createDataFrame([(0, " ".join(item), "e"), (0, " ".join(item), "e"), (7, "short ITEM", "e"), (8, None, "e"), (9, "", "e")], "item_id long, text string, words string")
    rows += [(None, "no passage at all"), (None, " ".join(item[:13])), (1, "intro " + " ".join(item) + " end")]
    want = {(1, 0, 13, 13), (2, 0, 12, 13), (5, 7, 2, 2), (1, 7, 2, 2), (None, 0, 13, 13)}
    whole = []
    for few, size in ((decontam.BROADCAST_SEEDS, decontam.BROADCAST_BYTES), (0, decontam.BROADCAST_BYTES), (decontam.BROADCAST_SEEDS, 10)):
        monkeypatch.setattr(decontam, "BROADCAST_SEEDS", few)
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", size)
        whole.append(sorted(map(tuple, decontam.contaminations(table(spark, rows), bench).collect()), key=repr))
        got = {(r.doc_id, r.item_id, r.matched, r["of"]) for r in decontam.contaminations(table(spark, rows), bench).collect()}
        assert {(d, i) for d, i, *_ in got} == {(d, i) for d, i, *_ in want} and all(m >= 11 for _, i, m, _ in got if i == 0)
    assert whole[0] == whole[1] == whole[2] and len(whole[0]) == len(want)
    assert {r.doc_id for r in decontam.decontaminate(table(spark, rows), bench).collect()} == {3, 4, 6, None}
    assert decontam.contaminations(none, bench).count() == decontam.contaminations(docs, bench.limit(0)).count() == 0
    assert "Python" not in decontam.contaminations(docs, bench)._jdf.queryExecution().toString()


def brute_contaminations(rows, items, window=13, percent=80):
    out = set()
    for d, a in rows:
        for i, b in items:
            of = min(window, len(b))
            for at in range(1 - len(b), len(a)):
                equal = [0 <= at + k < len(a) and a[at + k] == w for k, w in enumerate(b)]
                if max(sum(equal[p : p + of]) for p in range(len(b) - of + 1)) * 100 >= of * percent:
                    out.add((d, i))
    return out


def substituted(item, places):
    return [f"x{k}" if k in places else w for k, w in enumerate(item)]


def test_decontamination_finds_every_placement_of_two_substitutions(spark, monkeypatch):
    items = [(n, [f"w{n}q{k}" for k in range(n)]) for n in (11, 12, 13, 14, 15)]
    rows = []
    for _, item in items:
        for a, b in combinations(range(len(item)), 2):
            passage = substituted(item, {a, b})
            rows.append((len(rows), passage if len(rows) % 2 else ["pre", *passage, "post"]))
        rows += [(len(rows), item[2:]), (len(rows) + 1, item[:-2]), (len(rows) + 2, item[1:-1]), (len(rows) + 3, substituted(item, {0, 5, 9}))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = brute_contaminations(rows, items)
    assert len(want) > 400
    for few in (decontam.BROADCAST_SEEDS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_SEEDS", few)
        got = decontam.contaminations(table(spark, [(d, " ".join(w)) for d, w in rows]), bench).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want


def test_decontamination_of_short_items(spark, monkeypatch):
    items = [(n, [f"w{n}q{k}" for k in range(n)]) for n in range(1, 11)]
    rows = []
    for _, item in items:
        for k in range(4):
            for places in combinations(range(len(item)), k):
                rows.append((len(rows), ["pre", *substituted(item, places), "post"]))
        rows += [(len(rows), item[1:]), (len(rows) + 1, item[:-1])]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = brute_contaminations(rows, items)
    assert {i for d, i in want} == set(range(1, 11)) and len(want) > 90
    for few in (decontam.BROADCAST_SEEDS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_SEEDS", few)
        got = decontam.contaminations(table(spark, [(d, " ".join(w)) for d, w in rows]), bench).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want


def test_masks_leave_no_placement_out():
    for n in range(1, 17):
        for percent in (60, 80, 90, 100):
            spare, masks = n - -(-n * percent // 100), decontam.masks_for(n, percent)
            for out in combinations(range(n), spare):
                assert any(all(c == "." or p + i not in out for i, c in enumerate(m)) for m in masks for p in range(n - len(m) + 1))


def test_simple8b_round_trip():
    rnd = np.random.default_rng(0)
    for n, top in ((0, 2), (1, 2), (500, 2), (500, 300), (5000, 50_000), (300, 1 << 62)):
        x = rnd.integers(0, top, n).astype(np.uint64)
        x[rnd.random(n) < 0.1] = (1 << 64) - 1 if top > 1 << 60 else 0
        lengths = np.array([0, n // 3, 0, n - n // 3], dtype=np.int64)
        words, sizes = simple8b.pack(x, lengths)
        assert (simple8b.unpack(words) == x).all() and sizes.sum() == len(words)
        assert (simple8b.unpack(words[: sizes[:2].sum()]) == x[: n // 3]).all()


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_as_the_whole(file):
    coder = Encoder(file, memo_pieces=20)
    rnd = random.Random(4)
    signs = list("ab Z1.,  \n\n!?'\"-_\u00e9\u4e2dn\u0301\u0130\u00df\u00bd\u00b2()<|>;:\u3000\xa0\t\r")
    texts = [t or "" for _, t in odd_rows()] + [" a", "a ", "a\n\nb", "don't, it's. x'.", "x_. y", "x . y", "<|endoftext|> z", ".", ", a", "a \x01 b", "a\0b", "\u00e9. z", "a.,\nb"]
    texts += ["".join(rnd.choice(signs) for _ in range(rnd.randrange(30))) for _ in range(2000)]
    texts += [r.text or "" for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).to_pandas().itertuples()]
    whole = [np.array(x.ids, dtype="<u4").tobytes() for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    raw = [t.encode() for t in texts]
    assert coder.encode(raw) == whole and coder.encode(raw[::-1], 1000) == whole[::-1]
    assert coder.encode([]) == [] and coder.encode([b"", b""]) == [b"", b""]


def test_token_files(docs, none, spark, tmp_path):
    path = queries.WORD_BPE
    coder, at, want = Encoder(path), 0, []
    for i, t in sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
        want.append((i, at, len(ids), token_io.crc(ids)))
        at += len(ids)
    got = token_io.ids_digest(token_io.token_files(docs, path, path=f"file://{tmp_path}/t")).orderBy("start").collect()
    assert list(map(tuple, got)) == want
    assert token_io.token_files(none, path).count() == 0


def test_shards(docs, none, spark):
    got = sharding.shard_by_bytes(docs, 4).collect()
    rows = sorted((i is not None, i or 0, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in odd_rows())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == rows
    for s in range(4):
        own = [r.slot for r in got if r.shard == s]
        assert sorted(own) == list(range(len(own)))
    assert sharding.shard_by_bytes(none).count() == 0


def test_shards_hold_equal_texts_together(spark):
    rnd = random.Random(3)
    copies = [400, 90, 60, 60, 30, 30, 3, 2, 2, 2] + [1] * 900
    texts = [t for k, n in enumerate(copies) for t in [f"{k} " + "x" * (50 + k % 40)] * n]
    rnd.shuffle(texts)
    got = sharding.shard_by_bytes(table(spark, list(enumerate(texts))).repartition(5), 8).collect()
    total, sizes, where = sum(len(t) + 1 for t in texts), [0] * 8, {}
    for r in got:
        sizes[r.shard] += r["size"]
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(got) == len(texts) and max(sizes) - min(sizes) <= total / 8 / 50
    assert [len(where[t]) for t in sorted(where, key=lambda t: -texts.count(t))] == [len(where[max(where, key=texts.count)]), *[1] * (len(where) - 1)]
    for s in range(8):
        own = [r.slot for r in got if r.shard == s]
        assert sorted(own) == list(range(len(own)))


def test_media(docs, none, spark):
    got = media.media_digest(media.store_texts(docs)).collect()
    want = sorted((i or 0, hashlib.sha256(b + b"\xff" * ((-len(b)) % 576 if b else 576)).hexdigest()) for i, b in ((i, (t or "").encode()) for i, t in odd_rows()))
    assert sorted((r.doc_id or 0, r.payload_sha256) for r in got) == want
    plain = {(i, t or "") for i, t in odd_rows()}
    by_payload = {}
    for i, t in plain:
        raw = t.encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        by_payload[hashlib.sha256(payload).hexdigest()] = (len(raw), len(payload), crc32(payload[-32:]), media.write_container(payload, keyframe_every=8), raw)
    for r in got:
        n, size, tail, file, raw = by_payload[r.payload_sha256]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, size, tail)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert len({(r.payload_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert len({r.media_sha256 for r in got if r.doc_id in (3, 5, 9)}) == 1
    assert media.media_digest(media.store_texts(none)).count() == 0
    good = media.write_container(bytes(range(256)) * 18, keyframe_every=3)
    files = spark.createDataFrame([(1, good), (2, None), (3, b""), (4, good[:100]), (5, b"\0\0\0\1junk")], "doc_id long, media binary")
    info = {r.doc_id: r for r in media.media_columns(files).collect()}
    assert (info[1].codec, info[1].n_samples, info[1].n_keyframes, info[1].seconds) == ("raw ", 8, 3, 0.576) and info[1].error is None
    assert all(info[k].codec is None and info[k].error for k in (2, 3, 4, 5))
    k = info[1].keyframes[1]
    assert (k["sample"], good[k["start"] : k["end"]]) == (3, (bytes(range(256)) * 18)[3 * 576 : 4 * 576])


def test_wide_boxes():
    inner = media.write_container(b"x" * 576)
    grown = b"\0\0\0\1free" + (24).to_bytes(8, "big") + b"12345678" + b"\0\0\0\0mdat" + b"rest"
    assert [p[-1] for p, _, _ in media.walk(inner + grown)][-2:] == [b"free", b"mdat"]
    assert media.read_payload(inner, media.read_tracks(inner)[0]) == b"x" * 576


def test_hilbert_keys_are_a_walk_through_all_cells():
    for dims, bits in ((2, 3), (3, 2)):
        n = 1 << bits
        cells = np.array(np.meshgrid(*[np.arange(n)] * dims)).reshape(dims, -1).T
        keys = packing.hilbert_keys(cells, bits)
        walk = cells[np.argsort(keys)]
        assert sorted(keys.tolist()) == list(range(n**dims)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing(docs, none):
    path = queries.BYTE_BPE
    coder = Encoder(path)
    pieces = packing.pack_along_curve(docs, path, length=256).collect()
    want = sorted((i or 0, len(coder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in odd_rows())
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in pieces if r.start == 0) == want
    assert sum(r.length for r in pieces) == sum(n for _, n in want)
    seqs = {}
    for r in pieces:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0  # nothing is padded
    ids = np.array([*coder.tokenizer.encode(dict(odd_rows())[15], add_special_tokens=False).ids, 1])
    for r in pieces:
        if r.doc_id == 15:
            assert r.ids_crc32 == token_io.crc(ids[r.start : r.start + r.length])
    assert packing.pack_along_curve(none, path).count() == 0


def test_language(spark, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    models = langid.train(docs.filter(langid.learnable()))
    got = langid.identify(docs, models).collect()
    held = [r for r in got if crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    # each context's probabilities add up to no more than 1
    p = np.array([np.exp(models.word_scores([c])[:, :-1]).sum(axis=0) for c in "abcdefghijklmnopqrstuvwxyzäöüßéèêçñáíóú"])
    assert (p.sum(axis=0) <= 1).all()
    odd = langid.identify(table(spark, [(1, None), (2, ""), (3, "12 ?!"), (4, "qzxj wvkq xzqj " * 40), (5, "²½")]), models)
    by = {r.doc_id: r for r in odd.collect()}
    assert all((by[k].lang_pred, by[k].score, by[k].rejected) == ("und", 0.0, True) for k in (1, 2, 3, 5))
    assert by[4].rejected and by[4].lang_pred in models.langs
    assert langid.identify(none, models).count() == 0 and langid.accepted(none, models).columns == none.columns
    nothing = langid.train(none)
    bare = langid.identify(table(spark, [(1, None), (2, ""), (3, "words")]), nothing).collect()
    assert {(r.doc_id, r.lang_pred, r.score, r.rejected) for r in bare} == {(1, "und", 0.0, True), (2, "und", 0.0, True), (3, "und", 0.0, False)}
    assert [r.doc_id for r in langid.accepted(table(spark, [(1, None), (3, "words")]), nothing).collect()] == [3]
    assert langid.identify(none, langid.train(docs.withColumn("lang", F.lit(None).cast("string")))).count() == 0


def test_languages_left_out_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for left_out in ("fr", "es"):
        models = langid.train(docs.filter(F.col("lang") != left_out))
        by = {r.own: r for r in langid.identify(docs, models).groupBy((F.col("lang") == left_out).alias("own")).agg(F.avg(F.col("rejected").cast("int")).alias("share"), F.count("*").alias("n")).collect()}
        assert by[True].n > 100 and by[True].share >= 0.85 and by[False].share <= 0.01


def test_junk_among_the_labelled_does_not_lift_the_bar(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").select("doc_id", "text", "lang")
    rnd = random.Random(8)
    junk = [(10**6 + k, " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(80)), "en") for k in range(30)]
    models = langid.train(docs.unionByName(spark.createDataFrame(junk[:6], docs.schema)))
    fresh = langid.identify(spark.createDataFrame(junk[6:], docs.schema), models).collect()
    assert sum(r.rejected for r in fresh) >= 22
    assert langid.identify(docs, models).filter("rejected").count() <= 2


def brute_kneser_ney(words, order):
    """Log probability of a word by the recursion of interpolated Kneser-Ney, on dictionaries."""
    raw = Counter()
    for w, n in words.items():
        s = "\x02" + w + "\x03"
        for i in range(1, len(s)):
            raw[s[max(0, i - order + 1) : i + 1]] += n
    level = {order: {g: n for g, n in raw.items() if len(g) == order}}
    for size in range(order - 1, 0, -1):
        level[size] = {g: len({h[0] for h in level[size + 1] if h[1:] == g}) + (raw[g] if len(g) == size else 0) for g in {h[1:] for h in level[size + 1]} | {g for g in raw if len(g) == size}}
    letters = len({c for g in raw for c in g})

    def p(context, c):
        size = len(context) + 1
        lower = 1 / (letters + 1) if not context else p(context[1:], c)
        ones, twos = (sum(n == k for n in level[size].values()) for k in (1, 2))
        d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5
        seen = {g[-1]: n for g, n in level[size].items() if g[:-1] == context}
        total = sum(seen.values())
        return lower if not total else max(seen.get(c, 0) - d, 0) / total + d * len(seen) / total * lower

    def score(w):
        s = "\x02" + w + "\x03"
        return sum(np.log(p(s[max(0, i - order + 1) : i], s[i])) for i in range(1, len(s)))

    return score


def test_kneser_ney_against_dictionaries(spark):
    words = {"x": Counter({"abc": 3, "ab": 2, "abab": 1, "cab": 4, "b": 1, "bacca": 2}), "y": Counter({"bca": 2, "cc": 5, "abca": 1, "acb": 3})}
    rows = [(k * 100 + j, " ".join([w] * n), lang, 0) for k, (lang, own) in enumerate(words.items()) for j, (w, n) in enumerate(own.items())]
    counts = {}
    for r in langid.count_grams(spark.createDataFrame(rows, "doc_id long, text string, lang string, n int"), 4).collect():
        counts.setdefault(r.lang, {})[r.gram] = r.n
    models = langid.fit(counts, 4)
    letters = {c for own in counts.values() for g in own for c in g}
    for k, lang in enumerate(models.langs):
        other = Counter()
        score = brute_kneser_ney(words[lang], 4)
        assert {c for g in counts[lang] for c in g} == letters  # the brute force counts its own language's alone
        for w in ("abc", "ab", "b", "cabab", "zz", "acbd", "bbbb", "a"):
            other[w] = models.word_scores([w])[0, k]
            assert abs(other[w] - score(w)) < 1e-6 * len(w + "..")


def test_toxicity(spark, none):
    rnd = random.Random(2)
    make = lambda bad: " ".join([*(rnd.choice(WORDS) for _ in range(40)), *(["Idiot!", "trash"] if bad else [])])
    rows = [(i, make(i % 4 == 0)) for i in range(2000)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(2000)] + [(1, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    model = toxicity.train(docs, labels.filter(toxicity.learnable()))
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.98
    assert len(model.index) < 3000
    odd = toxicity.score(table(spark, [(1, None), (2, ""), (3, "!!")]), model).collect()
    assert len({r.score for r in odd}) == 1 and 0 <= odd[0].score <= 1
    assert toxicity.score(none, model).count() == 0
    assert {r.score for r in toxicity.score(docs.limit(5), toxicity.train(docs, labels.limit(0))).collect()} == {0.5}


def brute_ftrl(examples, alpha, beta, l1, l2):
    z, n = Counter(), Counter()

    def weight(i, free):
        if abs(z[i]) <= (0 if free else l1):
            return 0.0
        return -(z[i] - np.sign(z[i]) * (0 if free else l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for at, y, free in examples:
        w = {i: weight(i, i == free) for i in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in at:
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    return lambda i, free: weight(i, i == free)


def test_ftrl_against_dictionaries():
    rnd = np.random.default_rng(3)
    bits, options = 6, dict(alpha=0.7, beta=1.0, l1=0.4, l2=0.5)
    model, examples = toxicity.Ftrl(bits, *options.values()), []
    for _ in range(300):
        at = np.append(np.unique(rnd.integers(0, 64, 6)), 1 << bits)
        y = int(at[0] % 3 == 0)
        model.learn(at, y)
        examples.append((at.tolist(), y, 1 << bits))
    want, found = brute_ftrl(examples, **options), model.weights(np.arange((1 << bits) + 1))
    assert all(abs(want(i, 1 << bits) - found[i]) < 1e-9 for i in range((1 << bits) + 1)) and (found == 0).any()


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL").collect()}
    got = [(r.score, labels[r.doc_id]) for r in queries.op10_toxicity(spark, sf).filter("held_out").collect() if r.doc_id in labels]
    good, bad = np.array([s for s, y in got if y == 0]), np.array([s for s, y in got if y == 1])
    assert len(bad) >= 20 and len(good) >= 300
    assert (bad[:, None] > good).mean() + 0.5 * (bad[:, None] == good).mean() > 0.9


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_is_what_its_sql_says(spark, duck, name):
    same(queries.queries()[name](spark, DATA), duck.execute(queries.oracle_sql()[name]))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DATA)
        assert kept.columns == docs.columns
        kept = corpus_pipeline.stored(kept, name)
    rows = kept.collect()
    assert decontam.contaminations(kept, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    want = groups_of([(r.doc_id, r.text) for r in rows])
    assert all(root == i for i, (_, root) in want.items())
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
    pieces = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in rows}
