"""Conversation repair against brute force."""

import hashlib
import random
import re
from zlib import crc32

import pyarrow.parquet as pq
import pytest
from conftest import DATA

from codeloom.llm import queries, repair

STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """Least (cost, audit) over all edits, rows being (initial, fault), with up to 3 insertions in a place."""

    def inserted(ways):
        out, last = {s: set(v) for s, v in ways.items()}, ways
        for _ in range(3):
            new = {}
            for s, v in last.items():
                for role in "ua":
                    if (s, role) in STEPS:
                        new.setdefault(STEPS[s, role], set()).update((c + 5, a + "I") for c, a in v)
            for s, v in new.items():
                out.setdefault(s, set()).update(v)
            last = new
        return out

    ways = inserted({0: {(0, "")}})
    for initial, fault in rows:
        new = {}
        for s, v in ways.items():
            new.setdefault(s, set()).update((c + 2, a + "D") for c, a in v)
            if fault != "d":
                more = 5 if fault == "t" else 0
                for role in "sua":
                    if (s, role) in STEPS:
                        to = new.setdefault(STEPS[s, role], set())
                        if role == initial:
                            to.update((c + more, a + "K") for c, a in v)
                        if role != "s":
                            to.update((c + 1 + more, a + "R") for c, a in v)
        ways = inserted({s: v for s, v in new.items() if v})
        least = min(min(v) for v in ways.values())[0]
        # no state is further than 17 from another
        ways = {s: {w for w in v if w[0] <= least + 17} for s, v in ways.items()}
    return min(ways.get(0, set()) | ways.get(3, set()))


def over_all_splits(rows):
    """The textbook's table: every span, every place to split it at."""
    cells = {(i, i + 1): repair.row_cell(*row) for i, row in enumerate(rows)}
    for size in range(2, len(rows) + 1):
        for i in range(len(rows) - size + 1):
            best = {}
            for k in range(i + 1, i + size):
                for symbol, way in repair.joined(cells[i, k], cells[k, i + size]).items():
                    best[symbol] = min(way, best.get(symbol, way))
            cells[i, i + size] = best
    return repair.answer(cells[0, len(rows)] if rows else repair.INSERTIONS)


def test_cells_against_all_splits_and_all_edits():
    rnd = random.Random(5)
    parser = repair.Parser(memo_rows=2, max_cells=50)
    for k in range(500):
        rows = [(rnd.choice("suaat "), rnd.choice("  td")) for _ in range(rnd.randint(0, 5 if k < 400 else 9))]
        got = repair.answer(parser.cell("".join(map("".join, rows))))
        assert got == over_all_splits(rows)
        if len(rows) <= 5:
            assert got == cheapest(rows)


def solved(rows):
    return over_all_splits(rows) if len(rows) < 12 else repair.answer(repair.Parser().cell("".join(map("".join, rows))))


def damage(rows):
    word = lambda v: " " if v is None else str(v)
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        h = crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if h <= 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def expected(rows, solve):
    out = []
    for conv, kept in damage(rows).items():
        seen, faults = set(), []
        for _, role, text in kept:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("b" if not last else "d" if (role, text) in seen else " " if last[0] in ".!?" else "t")
            seen.add((role, text))
        initials = [r[:1] or " " for _, r, _ in kept]
        cost, audit = solve([(i, "d" if f in "bd" else f) for i, f in zip(initials, faults)])
        pattern, lines, k = audit.replace("D", ""), [], 0
        roles = ["system"] * (len(pattern) % 2) + ["user", "assistant"] * (len(pattern) // 2)
        for edit in audit:
            if edit != "D":
                role = roles[len(lines)]
                assert edit != "K" or kept[k][1][0] == role[0]
                lines.append((kept[k][1] if edit == "K" else role) + ":" + (kept[k][2] if edit != "I" else ""))
            k += edit != "I"
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_rows(seed=3):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "What", "", " \t\n", "Why?  ", "été. ", "a\x0b", None, "A long line. And more"]
    rows = [(c, rnd.choice([None, t, t, t, t + 3]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "ursa"]), rnd.choice(texts) if rnd.random() < 0.4 else f"Line {rnd.random()}.") for c in (None, *range(60)) for t in range(rnd.randint(1, 7))]
    rows += [(77, t, ("user", "assistant")[t % 2 if rnd.random() < 0.9 else 0], "again." if rnd.random() < 0.1 else f"Turn {t}." if rnd.random() < 0.8 else "open") for t in range(400)]
    rows += [(78, 5, "user", "same.")] * 90
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, _kind int, piece int, whole boolean, part string, cost long"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, True, "x", 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("piece_rows, fan", [(20_000, 8), (7, 3), (1, 2)])
def test_odd_rows_in_pieces(spark, piece_rows, fan):
    rows = odd_rows()
    got = repair.repair_conversations(repair.damaged(frame_of(spark, rows).repartition(3)), piece_rows=piece_rows, fan=fan).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, solved)


def test_many_partitions(spark):
    rows = odd_rows(4)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repair.repair_conversations(repair.damaged(frame_of(spark, rows)), piece_bytes=200).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got), key=repr) == expected(rows, solved)


def test_nothing(spark):
    assert repair.repair_conversations(repair.damaged(frame_of(spark, []))).count() == 0
    gone = next(t for t in range(1000) if crc32(f"1:{t}".encode()) % 20 == 0)
    got = repair.repair_conversations(repair.damaged(frame_of(spark, [(1, gone, "user", "Hello.")]))).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{DATA}/conversations.parquet").to_pylist()]
    got = queries.op13_conversation_repair(spark, DATA).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, solved)
