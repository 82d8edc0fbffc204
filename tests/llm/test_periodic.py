"""Periodic runs against brute force."""

import hashlib
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
from conftest import DATA

from codeloom.llm import periodic, queries


def brute_runs(words, min_length=6, min_exponent=4):
    n, out = len(words), set()
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_length, min_exponent * q) and not any(all(words[t] == words[t + r] for t in range(i, j + q - r)) for r in range(1, q)):
                out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(seed, count):
    rnd = random.Random(seed)
    for _ in range(count):
        k, n = rnd.choice([1, 2, 2, 3, 5]), rnd.randint(0, 50)
        x = [rnd.randrange(k) for _ in range(n)]
        if n > 8 and rnd.random() < 0.6:
            a = rnd.randrange(n)
            p = 1 + (n - a) // rnd.randint(3, 10)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        yield list(periodic.numbered([b"%d" % v for v in x]))


def test_chains_are_the_lyndon_arrays():
    for x in sequences(1, 200):
        x = [int(v) for v in x]
        for values in (x, [-v for v in x]):
            got = [0] * len(x)
            for size, first, times in periodic.lyndon_chains(values):
                for k in range(times):
                    got[first + k * size] = size
            want = [max(m for m in range(1, len(x) - i + 1) if all(values[i : i + m] < values[i + r : i + m] for r in range(1, m))) for i in range(len(x))]
            assert got == want


def test_runs_against_brute_force():
    for x in sequences(2, 400):
        for shortest, exponent in ((6, 4), (3, 3), (9, 3), (5, 5), (7, 6)):
            assert periodic.find_runs(np.array(x, dtype=np.int64), shortest, exponent) == brute_runs(x, shortest, exponent)


def test_long_runs():
    x = np.array([*range(3000), *([1, 2, 1, 3] * 2000), *range(3000, 6000), *([7] * 5000)])
    assert periodic.find_runs(x) == [(3000, 8000, 4), (14000, 5000, 1)]


def expected(doc_id, text, planted):
    words = (text or "").encode().split()
    n, h = len(words), crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "x y x y x y x y x z"), (6, "  été " * 9), (7, "a b c a b c a b c a b c d d d d d d a b c d d d d d d a b c"), (0, "w " * 30000)]
    frame = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n_runs long, collapsed string, period string")
    for planted in (False, True):
        got = periodic.runs_digest(periodic.periodic_runs(frame.repartition(3), placed=periodic.repeat_tail if planted else None)).collect()
        want = [expected(i, t, planted) for i, t in rows if len(t or "") < 60000] + [tuple(r) for r in got if r.doc_id == 0]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
        assert [(r.start, r.length, r.period) for r in got if r.doc_id == 0] == [(0, 30000, 1)]
    full = {r.doc_id: r for r in periodic.periodic_runs(frame).collect()}
    assert full[5].collapsed == "a" and full[None].collapsed == "x y z" and [tuple(x) for x in full[None].runs] == [(0, 9, 2)]
    assert periodic.runs_digest(periodic.periodic_runs(frame.limit(0))).count() == 0


def test_query(spark):
    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, DATA).collect()}
    assert len(got) == len(docs)
    for d in docs:
        if len(d["text"] or "") < 8000:
            assert got[d["doc_id"]] == expected(d["doc_id"], d["text"], True)
