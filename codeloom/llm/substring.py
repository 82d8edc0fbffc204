"""Exact removal of word windows that an earlier document holds, by super-k-mer partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_table, fields, slices, stored, texts_of, utf8, window_hashes, word_hashes, word_spans

#: Words of the parts whose least hash is a window's minimiser.
PART = 8
#: A minimiser with more super-k-mers than this is split by windows.
HOT = 512

_HEADS = "doc_id long, th binary, minis array<long>, starts array<long>, sizes array<long>"
_SENT = "hot boolean, mini long, doc_id long, th binary, start long, packed binary"
_RUNS = "doc_id long, th binary, start long, n long"
_DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    have, out = 1, x
    while have < size:
        step = min(have, size - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out


def super_kmers(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each run of windows that share one."""
    starts, ends = word_spans(text)
    if len(starts) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = min(PART, window)
    least = _sliding_min(window_hashes(word_hashes(text, starts, ends), part), window - part + 1)
    first = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    return least[first].view(np.int64), first, np.diff(np.append(first, len(least)))


def _windows(packed: bytes, window: int) -> list[bytes]:
    starts, ends = word_spans(packed)
    return [packed[s:e] for s, e in zip(starts.tolist(), ends[window - 1 :].tolist())]


def _runs_of(at: list[int]) -> tuple[list[int], list[int]]:
    """Starts and lengths of the runs of consecutive numbers."""
    x = np.array(at, dtype=np.int64)
    first = np.append(0, np.flatnonzero(np.diff(x) != 1) + 1)
    return x[first].tolist(), np.diff(np.append(first, len(x))).tolist()


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Removes each word that lies in a window of so many words that starts in an earlier document too.

    Earlier is a smaller doc_id; words are [^\\x20\\x09-\\x0D]+ of the whole text, unchanged; windows
    are judged on the input. Returns doc_id, n_words, n_removed, kept_sha256 and kept (the words left,
    joined by one space, UTF-8).

    Of equal texts only the one with the smallest doc_id is looked into: all words of the others are
    in windows of it. Runs of windows with one minimiser (the least hash of their parts of 8 words)
    are first noted without their words. Only those whose minimiser occurs in two documents travel,
    as one string each, to the minimiser's bucket, where their windows are sorted. A bucket of more
    than HOT strings is split: its windows travel alone, as 128-bit digests, and their least doc_id
    is aggregated before the shuffle. So no task holds an unbounded group.

    Null or empty texts have no words. A row with a null doc_id is neither earlier nor later than any
    other and stays whole. Rows of one doc_id are not earlier than each other; copies of a row have
    the same result. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")

    def head(batches):
        batch_of = arrow_table(_HEADS)
        for b in slices(batches):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text"))):
                minis, starts, sizes = super_kmers(text, window)
                if len(minis):
                    out.append((doc, hashlib.md5(text).digest(), minis, starts, sizes))
            if out:
                yield batch_of([list(c) for c in zip(*out)])

    heads = rows.filter(F.col("doc_id").isNotNull()).mapInArrow(head, fields(_HEADS))
    one = heads.groupBy("th").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("minis", "starts", "sizes")))  # equal texts have equal arrays
    firsts = stored(one, "super-kmer-heads")
    kmers = firsts.select("doc_id", "th", F.explode(F.arrays_zip("minis", "starts", "sizes")).alias("k")).select("doc_id", "th", F.col("k.minis").alias("mini"), F.col("k.starts").alias("start"), F.col("k.sizes").alias("size"))
    shared = kmers.groupBy("mini").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).filter("a < b").select("mini", (F.col("n") > HOT).alias("hot"))
    shared = stored(shared, "shared-minimisers")  # as a table it lets a skewed join be split
    wanted = kmers.join(shared, "mini").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "size", "mini", "hot")).alias("wanted"))

    def send(batches):
        batch_of = arrow_table(_SENT)
        for b in slices(batches):
            out = []
            for doc, th, text, wants in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), texts_of(b.column("text")), b.column("wanted").to_pylist()):
                starts, ends = word_spans(text)
                for w in wants:
                    s, e = w["start"], w["start"] + w["size"] + window - 1
                    # words are put together by one space, whatever was between them
                    packed = b" ".join([text[x:y] for x, y in zip(starts[s:e].tolist(), ends[s:e].tolist())])
                    if w["hot"]:
                        out += [(True, w["mini"], doc, th, s + i, xxhash.xxh3_128_digest(x)) for i, x in enumerate(_windows(packed, window))]
                    else:
                        out.append((False, w["mini"], doc, th, s, packed))
                if len(out) > 20_000:
                    yield batch_of([list(c) for c in zip(*out)])
                    out = []
            if out:
                yield batch_of([list(c) for c in zip(*out)])

    keyed = rows.withColumn("th", F.unhex(F.md5(utf8("text"))))
    sent = stored(keyed.join(wanted, ["doc_id", "th"]).mapInArrow(send, fields(_SENT)), "super-kmers")

    def bucket(batches):
        """Sorts the windows of one minimiser after another; rows come in the order of minimisers."""
        batch_of = arrow_table(_RUNS)

        def done(group):
            windows = sorted((x, doc, i, start + at) for i, (doc, _, start, packed) in enumerate(group) for at, x in enumerate(_windows(packed, window)))
            late: dict[int, list[int]] = {}
            last, first = None, None
            for x, doc, i, at in windows:
                if x != last:
                    last, first = x, doc
                elif doc > first:
                    late.setdefault(i, []).append(at)
            for i, ats in late.items():
                for s, n in zip(*_runs_of(sorted(ats))):
                    yield group[i][0], group[i][1], s, n

        mini, group, out = None, [], []
        for b in batches:
            for m, *row in zip(*(b.column(c).to_pylist() for c in ("mini", "doc_id", "th", "start", "packed"))):
                if m != mini:
                    out += done(group)
                    mini, group = m, []
                group.append(row)
            if out:
                yield batch_of([list(c) for c in zip(*out)])
                out = []
        out += done(group)
        if out:
            yield batch_of([list(c) for c in zip(*out)])

    cold = sent.filter(~F.col("hot")).select("mini", "doc_id", "th", "start", "packed").repartition("mini").sortWithinPartitions("mini", "doc_id", "start").mapInArrow(bucket, fields(_RUNS))
    alone = sent.filter("hot").select(F.col("packed").alias("digest"), "doc_id", "th", "start")
    least = alone.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    least = stored(least, "hot-windows")
    split = alone.join(least, "digest").filter("least < doc_id").select("doc_id", "th", "start", F.lit(1).cast("long").alias("n"))
    runs = cold.unionByName(split).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    marks = firsts.select("doc_id", "th").join(runs, ["doc_id", "th"], "left").select("doc_id", "th", F.coalesce("runs", F.array().cast("array<struct<start:bigint,n:bigint>>")).alias("runs"))

    def keep(batches):
        batch_of = arrow_table(_DONE)
        for b in slices(batches):
            out = []
            for doc, text, runs in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")), b.column("runs").to_pylist()):
                starts, ends = word_spans(text)
                n = len(starts)
                gone = np.zeros(n + 1, dtype=np.int64)
                if runs is None and doc is not None and n >= window:  # a copy of an earlier text
                    gone[0] = 1
                for r in runs or ():
                    gone[r["start"]] += 1
                    gone[r["start"] + r["n"] + window - 1] -= 1
                left = np.cumsum(gone)[:n] == 0
                kept = b" ".join([text[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist())])
                out.append((doc, n, n - int(left.sum()), hashlib.sha256(kept).hexdigest(), kept))
            if out:
                yield batch_of([list(c) for c in zip(*out)])

    return keyed.join(marks, ["doc_id", "th"], "left").select("doc_id", "text", "runs").mapInArrow(keep, fields(_DONE))
