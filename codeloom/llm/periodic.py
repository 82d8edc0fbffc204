"""Periodic runs of words by Baier's grouping of suffixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_table, fields, mix, slices, texts_of

_RUNS = "doc_id long, n_words long, n_runs long, start long, length long, period long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon_chains(values: list[int]) -> Iterator[tuple[int, int, int]]:
    """The longest Lyndon words of a sequence that start at each place, by phase one of Baier's sorter.

    Places are grouped by the words they start with, and groups are taken from the greatest to the
    least. When a group is taken, the word u of its places is final: it is the longest Lyndon word
    there, and reaches to the next place not yet taken. The nearest place to the left that is not taken
    has its word lengthened by u as often as u follows, and moves to a group of its own above its former
    one, the further the oftener. Yields (length of u, first place, times u follows itself); all such
    chains together are the Lyndon array. Every place is taken once and only a taken place moves another.
    """
    n = len(values)
    left, right = list(range(-1, n)), list(range(1, n + 2))
    by_value: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        by_value.setdefault(v, []).append(i)
    members = [by_value[v] for v in sorted(by_value)]
    group = [0] * n
    for g, places in enumerate(members):
        for i in places:
            group[i] = g
    lower, higher = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    g = len(members) - 1
    while g >= 0:
        places = [i for i in members[g] if group[i] == g]  # those that moved on are left out
        members[g] = []
        moved: dict[int, list[tuple[int, int]]] = {}
        at = 0
        while at < len(places):
            first = last = places[at]
            size, at = right[first] - first, at + 1
            times = 1
            while at < len(places) and places[at] == last + size:
                last, at, times = places[at], at + 1, times + 1
            yield size, first, times
            before, after = left[first], right[last]
            left[after] = before
            if before >= 0:
                right[before] = after
                moved.setdefault(group[before], []).append((times, before))
        for old, changes in moved.items():
            changes.sort()
            below, above, latest = old, higher[old], 0
            for times, i in changes:
                if times != latest:
                    new, latest = len(members), times
                    members.append([])
                    lower.append(below)
                    higher.append(above)
                    higher[below] = lower[above] = new
                    below = new
                members[below].append(i)
                group[i] = below
        g = lower[g]


def common_extension(a: np.ndarray, b: np.ndarray) -> int:
    """How far two sequences agree from their starts, looked at in blocks of doubling size."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differ = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def runs_in(ids: np.ndarray, min_length: int, min_exponent: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least that length and that many periods.

    A run's period is the length of a Lyndon word, of the order of the words or of its reverse, that is
    longest at each place of the run where it starts; so it is a chain of equal words, extended to both
    sides as far as words one period apart are equal.
    """
    found = set()
    for values in (ids, -ids):
        for size, first, times in lyndon_chains(values.tolist()):
            # a run of e periods holds e - 1 whole roots at least, and less than a root more on each side
            if times < min_exponent - 1 or (times + 2) * size - 2 < min_length:
                continue
            start = first - common_extension(ids[first - 1 :: -1] if first else ids[:0], ids[first + size - 1 :: -1])
            stop = first + times * size
            stop += common_extension(ids[stop:], ids[stop - size :])
            if stop - start >= max(min_length, min_exponent * size):
                found.add((start, stop - start, size))
    return found


def stretches(ids: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """The parts of a sequence of numbers from 0 that can hold a run; all others can't.

    Each three consecutive words of a run stand in it at least min_exponent - 1 times (once less if the
    period is 1 and nothing longer is asked for), and all its triples start side by side. Triples that
    are rarer within the part they stand in go, until none does. Triples are told by a hash: if two
    share one, a part stays that need not.
    """
    often = min_exponent - 1 if min_length > min_exponent else min_exponent - 2
    if len(ids) < max(min_length, 3):
        return []
    common = np.bincount(ids)[ids] >= often
    at = np.flatnonzero(common[:-2] & common[1:-1] & common[2:])
    x = ids.astype(np.uint64)
    triples = mix((x[at] * np.uint64(0x9E3779B97F4A7C15) + x[at + 1]) * np.uint64(0xD1342543DE82EF95) + x[at + 2])
    while len(at):
        edge = np.concatenate(([True], np.diff(at) != 1))
        part = np.cumsum(edge) - 1
        _, which, counts = np.unique(triples + mix(part.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
        stay = (counts[which] >= often) & (np.bincount(part)[part] >= min_length - 2)
        if stay.all():
            starts = np.flatnonzero(edge)
            return [(int(at[a]), int(at[b - 1]) + 3) for a, b in zip(starts, np.append(starts[1:], len(at)))]
        at, triples = at[stay], triples[stay]
    return []


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, counted from 0 as they come."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))


def find_runs(ids: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """All runs of a sequence of numbers from 0, ordered by start and then period."""
    if min_exponent < 3 or min_length < 3:
        raise ValueError("runs of fewer than 3 periods or words are not told by their chains")
    found = []
    for a, b in stretches(ids, min_length, min_exponent):
        found += [(a + s, n, q) for s, n, q in runs_in(ids[a:b], min_length, min_exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int | None, int | None, int | None]:
    """The run of most periods, compared exactly; the first of equals, then that of the least period."""
    best: tuple = (None, None, None)
    for start, n, q in runs:
        if best[0] is None or n * best[2] > best[1] * q:
            best = (start, n, q)
    return best


def repeat_tail(doc_id: int | None, n: int) -> np.ndarray:
    """For each of n words the place of the word that stands there once a tail has been made periodic.

    A tenth of the documents, told by the checksum of doc_id, has one; no doc_id, no tail.
    """
    order = np.arange(n)
    h = crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        order[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return order


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, placed: Callable[[int | None, int], np.ndarray] | None = None) -> DataFrame:
    """The runs of each document's words and its text without the repeats.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text. A run is a stretch of words with smallest period q,
    of at least min_length words and min_exponent times q, that no word beside it extends. Returns
    doc_id, n_words, n_runs, start, length and period of the run of most periods (null without any),
    runs (all of them, by start and then period), and collapsed: the words that no run repeats, that is
    which lie in no run after its first q words, joined by one space. placed may give, from doc_id and
    the number of words, the places of the words to use instead.

    Documents are worked on where they lie; nothing is shuffled. A task holds one batch of whole texts.
    Null and empty texts have no words and no runs. Rows with a null or repeated doc_id are rows of
    their own. An empty table gives no rows. Other columns are ignored, whatever their names.
    """

    def one(doc_id: int | None, text: bytes) -> tuple:
        words = text.split()
        ids = numbered(words)
        if placed is not None:
            order = placed(doc_id, len(words))
            if not np.array_equal(order, np.arange(len(words))):
                words, ids = [words[i] for i in order.tolist()], ids[order]
        runs = find_runs(ids, min_length, min_exponent)
        if runs:
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for start, n, q in runs:
                gone[start + q] += 1
                gone[start + n] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        listed = [{"start": s, "length": n, "period": q} for s, n, q in runs]
        return (doc_id, len(ids), len(runs), *strongest(runs), listed, b" ".join(words).decode())

    def run(batches):
        batch_of = arrow_table(_RUNS)
        for b in slices(batches):
            rows = [one(d, t) for d, t in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")))]
            if rows:
                yield batch_of([list(c) for c in zip(*rows)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields(_RUNS))


def runs_digest(runs: DataFrame) -> DataFrame:
    """The result of periodic_runs with checksums instead of lists and texts."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    exponent = F.expr("1000 * length div period").cast("long").alias("exponent_milli")
    return runs.select("doc_id", "n_runs", "start", "length", "period", exponent, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
