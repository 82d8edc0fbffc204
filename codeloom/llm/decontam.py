"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, utf8

#: Of a window of so many words, those at # are equal; alignments report how many such windows they hold.
MASKS = ("###.#..##.#", "##..#.##.##")
SPAN = 11
#: More seeds of the benchmark than this, or seeds whose items' words take more bytes, are not broadcast.
BROADCAST_SEEDS, BROADCAST_BYTES = 500_000, 64 << 20


def masks_for(words: int, matched_percent: int) -> list[str]:
    """Masks one of which hits wherever matched_percent in a hundred of so many aligned words are equal.

    With k substitutions allowed the words are cut into k + 2 blocks (k + 1 if they are no more words).
    At most k blocks hold a substitution, so the mask without those, one of all that leave out k blocks,
    has equal words only. Outer dots are cut off, which also lets a passage reach over a text's end.
    """
    spare = words - -(-words * matched_percent // 100)
    blocks = min(spare + 2, words)
    cuts = [-(-words * b // blocks) for b in range(blocks + 1)]
    sizes = [b - a for a, b in zip(cuts, cuts[1:])]
    left_out = combinations(range(blocks), spare)
    return sorted({"".join((".", "#")[b not in out] * n for b, n in enumerate(sizes)).strip(".") for out in left_out})


def words_of(text: str) -> Column:
    """Lower-cased runs of letters and digits; [] for null or none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(words: DataFrame, masks: list[tuple[int, str]]) -> DataFrame:
    """A row for each window and mask: at (the window's first word, from 0) and seed (its hash).

    Windows are exploded with the word array beside them and hashed in the same generated code, which
    does not copy the array.
    """
    size, shortest = F.size("words"), min(len(m) for _, m in masks)
    # no filter on the size: it would be pushed to the scan and split the text once more
    at = F.explode(F.when(size >= shortest, F.sequence(F.lit(0), size - shortest))).alias("at")
    windows = words.select("*", at)
    # the mask's number is hashed too, so seeds of different masks do not meet
    hashes = {m: F.xxhash64(F.lit(k), *(F.get("words", F.col("at") + i) for i, c in enumerate(m) if c == "#")) for k, m in masks}
    inside = [h if len(m) == shortest else F.when(F.col("at") + len(m) <= size, h) for m, h in hashes.items()]
    return windows.select("*", F.explode(F.array(*inside)).alias("seed")).filter("seed IS NOT NULL")


def text_key(text_col: str) -> Column:
    """A digest that tells rows of one id, or of none, apart by their texts; null is as empty."""
    return F.md5(utf8(text_col))


def _alignments(docs: DataFrame, benchmark: DataFrame, window: int, matched_percent: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """doc_id, _text (the text's digest), item_id, doc_word, of, seeds and matched of every alignment
    that a mask hits."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(item_text).alias("words")).distinct().filter(F.size("words") > 0)
    whole = items.withColumn("_n", F.least(F.size("words"), F.lit(window)))
    sizes = sorted(r._n for r in whole.select("_n").distinct().collect())  # at most window
    shapes = {n: masks_for(n, matched_percent) for n in sizes}
    masks = list(enumerate(sorted({m for shape in shapes.values() for m in shape})))
    item_seeds = _seeds(whole.limit(0), [(0, "#")])
    for n, shape in shapes.items():
        item_seeds = item_seeds.unionByName(_seeds(whole.filter(F.col("_n") == n), [(k, m) for k, m in masks if m in shape]))
    sought = item_seeds.select("seed", "item_id", F.col("words").alias("item_words"), F.col("at").alias("item_at"))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("_text"), words_of(text_col).alias("words"))
    joined = F.concat_ws(" ", "item_words")
    seeds, size = sought.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(joined) + 16 * F.size("item_words")), F.lit(0))).first()
    if seeds <= BROADCAST_SEEDS and size <= BROADCAST_BYTES:
        hits = _seeds(texts, masks or [(0, "#")]).join(F.broadcast(sought), "seed").withColumn("doc_word", F.col("at") - F.col("item_at"))
    else:
        pairs = _seeds(texts, masks or [(0, "#")]).select("doc_id", "_text", "at", "seed").join(sought.select("seed", "item_id", F.md5(joined).alias("_words"), "item_at"), "seed")
        pairs = pairs.select("doc_id", "_text", "item_id", "_words", (F.col("at") - F.col("item_at")).alias("doc_word")).distinct()
        with_items = pairs.join(items.select(F.col("item_id").alias("_item"), F.col("words").alias("item_words"), F.md5(F.concat_ws(" ", "words")).alias("_digest")), F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("_words") == F.col("_digest")))
        fetched = texts.select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_of"), "words")
        hits = with_items.join(fetched, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_of")))
    # only the aligned words go on, still in generated code: functions with lambdas come after the
    # shuffle of the distinct, as they would end that code and copy the whole array into each hit
    n = F.size("item_words")
    aligned = F.slice("words", F.greatest(F.col("doc_word"), F.lit(0)) + 1, n + F.least(F.col("doc_word"), F.lit(0)))
    hits = hits.select("doc_id", "_text", "item_id", "doc_word", aligned.alias("aligned"), "item_words").distinct()
    of = F.least(n, F.lit(window))
    skipped = F.greatest(-F.col("doc_word"), F.lit(0))
    equal = F.transform("item_words", lambda w, k: F.when(F.get("aligned", F.greatest(k - skipped, F.lit(0))) == w, F.when(k >= skipped, 1).otherwise(0)).otherwise(0))
    best = F.array_max(F.transform(F.sequence(F.lit(1), n - of + 1), lambda p: F.aggregate(F.slice("equal", p, of), F.lit(0), lambda a, x: a + x)))
    whole_at = lambda m: lambda p: reduce(and_, (F.get("equal", p + i) == 1 for i, c in enumerate(m) if c == "#"))
    held = sum((F.size(F.filter(F.sequence(F.lit(0), n - SPAN), whole_at(m))) for m in MASKS), F.lit(0))
    seeds = F.when(n >= SPAN, held).otherwise(F.when(best == n, 1).otherwise(0)).cast("long")
    return hits.select("doc_id", "_text", "item_id", "doc_word", of.alias("of"), equal.alias("equal"), "item_words").select("doc_id", "_text", "item_id", "doc_word", "of", seeds.alias("seeds"), best.alias("matched"))


def contaminations(docs: DataFrame, benchmark: DataFrame, window: int = 13, matched_percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds a passage, tolerating substitutions.

    Texts are words (lower-cased runs of letters and digits). Wherever a masked window of a document
    has the hash of one of an item, the two texts are aligned there and compared word by word. The
    pair is returned if among window aligned words (the whole item if it is shorter) at least
    matched_percent in a hundred are equal; masks_for leaves out no such alignment. Returns doc_id, item_id, matched and of (the best window's
    equal words and length), doc_word, the aligned item's first word's place in the document, which may
    be negative, and seeds, the windows there that are equal under MASKS (the whole item if it is
    shorter), which may be none.

    The seeds are broadcast with the items' words if they are few and small, which is measured first.
    Else the seeds join by a shuffle, and the words are fetched again for hits alone, by id and a
    digest of the text; the result is the same. Null or empty texts on either side give no pairs.
    Repeated rows give the pairs once, rows of one id with different texts give the pairs of each,
    the best alignment of a pair being told, the first of equals. Null ids are a value like others.
    An empty table on either side gives no rows. Other columns are ignored.
    """
    checked = _alignments(docs, benchmark, window, matched_percent, id_col, text_col, item_col, item_text)
    return _best(checked, ["doc_id", "item_id"], matched_percent)


def _best(checked: DataFrame, key: list[str], matched_percent: int) -> DataFrame:
    """The best alignment of each key, the first of equals, if it has enough equal words. The filter
    comes last, lest it be moved into the join, and all columns are kept up to the aggregate, as equal
    words that only one column needs would be worked out again for each place."""
    top = F.min(F.struct((-F.col("matched")).alias("m"), "doc_word", "of", "seeds")).alias("top")
    pairs = checked.groupBy(*key).agg(top).select(*key, (-F.col("top.m")).alias("matched"), "top.of", "top.doc_word", "top.seeds")
    return pairs.filter(F.col("matched") * 100 >= F.col("of") * matched_percent)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, matched_percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any benchmark passage, their columns unchanged.

    Rows go by themselves: of rows with one doc_id, or with none, only those whose own text holds a
    passage go; repeated rows all go or all stay. Null and empty texts stay. An empty table gives an
    empty one, an empty benchmark removes nothing. Further columns may have any names.
    """
    doc, text = free_name(docs, "dirty"), free_name(docs, "dirty_text")
    checked = _alignments(docs, benchmark, window, matched_percent, id_col, text_col, item_col, item_text)
    dirty = _best(checked, ["doc_id", "_text"], matched_percent).select(F.col("doc_id").alias(doc), F.col("_text").alias(text))
    return docs.join(dirty, docs[id_col].eqNullSafe(dirty[doc]) & (text_key(text_col) == dirty[text]), "left_anti")
