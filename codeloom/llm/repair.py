"""Repair of conversations by weighted interval parsing.

What a repaired conversation's role initials may be, (s?(ua)+)?, is read by an automaton of four states:
START, SYSTEM after s, USER after u, REPLIED after ua; START and REPLIED may end. The grammar in Chomsky
normal form has a symbol for each pair of states that can follow one another, deriving the edits that lead
from one to the other, and a rule (p, q) -> (p, r) (r, q) for each state r between them.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_table, fields, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, REPLIED = range(4)
#: The automaton's steps: state, initial, next state.
STEPS = ((START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (USER, "a", REPLIED), (REPLIED, "u", USER))

Cell = dict[tuple[int, int], tuple[int, str]]


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two adjoining spans: for each symbol the least (cost, audit) over the rules.

    Two audits of one span and one cost are never each other's beginning, as the longer one would hold
    the same edits and further insertions, which cost; so the least audit of a span is part of the least
    of any longer one. Each derivation of a span is in some state at every border in it, so that all
    places to split a span at give the same cell, and one is enough.
    """
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is not None:
                total = cost + other[0]
                best = out.get((p, q))
                if best is None or total < best[0] or (total == best[0] and audit + other[1] < best[1]):
                    out[p, q] = (total, audit + other[1])
    return out


def _closure() -> Cell:
    """What insertions alone derive: nothing, or the cheapest way between two states."""
    steps: Cell = {(p, p): (0, "") for p in range(4)}
    steps |= {(p, q): (INSERT, "I") for p, initial, q in STEPS if initial in "ua"}
    return joined(joined(steps, steps), joined(steps, steps))


INSERTIONS = _closure()


def row_cell(initial: str, fault: str) -> Cell:
    """The cell of one row and the insertions after it. fault is " ", t (truncated) or d (to be deleted)."""
    out: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault != "d":
        extra = TRUNCATED if fault == "t" else 0
        for p, role, q in STEPS:
            ways = [(REROLE + extra, "R")] if role in "ua" else []
            if role == initial:
                ways.append((KEEP + extra, "K"))
            if ways:
                out[p, q] = min(ways)
    return joined(out, INSERTIONS)


class Parser:
    """Cells of spans of rows, each row two letters: its role's initial and its fault.

    Spans are aligned and of doubling length, from single rows up; those of at most memo_rows rows are
    kept, max_cells of them, as they recur in many conversations.
    """

    def __init__(self, memo_rows: int = 4, max_cells: int = 200_000) -> None:
        self.memo_rows, self.max_cells, self.cells = memo_rows, max_cells, {"": INSERTIONS}

    def cell(self, rows: str) -> Cell:
        found = self.cells.get(rows)
        if found is not None:
            return found
        n = len(rows) // 2
        if n == 1:
            found = row_cell(rows[0], rows[1])
        else:
            spans = [self.cell(rows[i : i + 2 * self.memo_rows]) for i in range(0, 2 * n, 2 * self.memo_rows)] if n > self.memo_rows else [self.cell(rows[:n // 2 * 2]), self.cell(rows[n // 2 * 2 :])]
            while len(spans) > 1:  # from short spans to long ones
                spans = [joined(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
            found = spans[0]
        if n <= self.memo_rows:
            if len(self.cells) >= self.max_cells:
                self.cells = {"": INSERTIONS}
            self.cells[rows] = found
        return found


def answer(whole: Cell) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation, insertions before its first row included."""
    out = joined(INSERTIONS, whole)
    return min(out[START, q] for q in (START, REPLIED) if (START, q) in out)


def repaired_lines(audit: str, roles: list[str], texts: list[str], used: int, system: bool) -> list[str]:
    """role:text of the rows that an audit, or a part of one, makes of rows, after used rows.

    Roles that are given or inserted follow from the places: user and assistant take turns, after a
    system row if there is one, which is when the repaired rows are odd in number.
    """
    out, k = [], 0
    for edit in audit:
        if edit == "K":
            out.append(f"{roles[k]}:{texts[k]}")
        elif edit != "D":
            out.append(f"{('user', 'assistant')[(used + len(out) - system) % 2]}:{texts[k] if edit == 'R' else ''}")
        k += edit != "I"
    return out


def has_system(audit: str) -> bool:
    return (len(audit) - audit.count("D")) % 2 == 1


# Rows of conversations ---------------------------------------------------------------------------

_SPACE = " \t\n\x0b\f\r"

_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = "part int, piece int, initials string, flags string, turns array<long>, roles array<string>, texts array<string>, digests array<binary>"
_GATHERED = f"{_RESULT}, whole boolean, {_PIECE}"
_SPAN = "n long, blank long, duplicate long, truncated long, illegal long, initials string, turns array<long>, distinct long, symbols array<long>, costs array<long>, audits array<string>"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with a fifth of their kinds of damage, told by the checksum of conv_id and turn.

    A twentieth each is dropped, emptied, loses its full stops, question and exclamation marks, is
    repeated, or gets the role user. Null roles and texts are one space, as null ids and turns are in
    the checksum. Returns conv_id, turn, role, text and copies: 0 for a dropped row, whose conversation
    is to be told, 2 for a repeated one, else 1.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat_ws(":", word("conv_id"), word("turn")), "UTF-8")) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), word("role").alias("role"), word("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") <= 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _digest(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _gaps(first: int, last: int, distinct: int) -> int:
    return last - first + 1 - distinct


def _rows(initials: list[str], faults: list[str]) -> str:
    return "".join(i + ("d" if f in "bd" else f) for i, f in zip(initials, faults))


def _gather(rows: DataFrame, piece_rows: int, piece_bytes: int) -> DataFrame:
    """Finished results of conversations that lie within one partition, and pieces of all others.

    Rows are range-partitioned by conversation and turn, so that a long conversation is spread over
    partitions. The first and last conversation of a partition may go on in the next, and longer ones
    than a piece are cut; such pieces carry their rows, at most piece_rows or about piece_bytes each.
    """
    first = F.substring("text", 1, 32)
    tail = F.rtrim("text", F.lit(_SPACE))
    flag = F.when(F.length(tail) == 0, "b").when(F.substring(tail, -1, 1).isin(".", "!", "?"), " ").otherwise("t")
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("_first")]
    # the last keys only keep many alike rows from being one key
    ordered = rows.select("*", first.alias("_first"), flag.alias("flag"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    placed = ordered.repartitionByRange(*keys, "_hash", "_row").sortWithinPartitions(*keys, "_hash", "text", "_row")

    def run(batches):
        part, parser, batch_of = TaskContext.get().partitionId(), Parser(), arrow_table(_GATHERED)
        out: list[tuple] = []
        names, pieces, cut, size = 0, 0, False, 0
        turns, roles, texts, flags = [], [], [], []

        def whole(conv) -> tuple:
            seen, faults = set(), []
            for row, f in zip(zip(roles, texts), flags):
                faults.append("d" if f != "b" and row in seen else f)
                seen.add(row)
            initials = [r[:1] or " " for r in roles]
            cost, audit = answer(parser.cell(_rows(initials, faults)))
            lines = repaired_lines(audit, roles, texts, 0, has_system(audit))
            known = [t for t in turns if t is not None]
            gaps = _gaps(known[0], known[-1], len(set(known))) if known else 0
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            return (conv, gaps, *map(faults.count, "bdt"), _illegal(initials), cost, audit, digest, True, *[None] * 8)

        def piece(conv) -> tuple:
            digests = list(map(_digest, roles, texts))
            initials, known = "".join(r[:1] or " " for r in roles), [t for t in turns if t is not None]
            return (conv, *[None] * 8, False, part, pieces, initials, "".join(flags), known, list(roles), list(texts), digests)

        conv, begun = None, False
        for b in batches:
            for now, turn, role, text, copies, flag in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "flag"))):
                ends = begun and now != conv
                if ends or len(roles) >= piece_rows or size >= piece_bytes:
                    cut = cut or not ends
                    out.append(piece(conv) if cut or names == 0 else whole(conv))
                    pieces, size = pieces + 1, 0
                    for held in (turns, roles, texts, flags):
                        held.clear()
                    if ends:
                        names, cut = names + 1, False
                conv, begun = now, True
                for _ in range(copies):
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    flags.append(flag)
                    size += len(text)
                if len(out) >= 1000 or (out and not out[-1][9]):
                    yield batch_of([list(c) for c in zip(*out)])
                    out.clear()
        if begun:
            out.append(piece(conv))
        if out:
            yield batch_of([list(c) for c in zip(*out)])

    return placed.select("conv_id", "turn", "role", "text", "copies", "flag").mapInArrow(run, fields(_GATHERED))


# Conversations in pieces -------------------------------------------------------------------------


def _one_span(initials: str, flags: str, turns: list[int], fresh: list[int] | None, parser: Parser) -> tuple:
    new = set(fresh or ())
    faults = ["d" if f != "b" and k not in new else f for k, f in enumerate(flags)]
    cell = parser.cell(_rows(list(initials), faults))
    ends = [turns[0], turns[-1]] if turns else []
    return (len(flags), *map(faults.count, "bdt"), _illegal(list(initials)), initials[:1] + initials[-1:], ends, len(set(turns)), *_told(cell))


def _told(cell: Cell) -> tuple:
    return [4 * p + q for p, q in cell], [c for c, _ in cell.values()], [a for _, a in cell.values()]


def _joined_spans(a: dict, b: dict) -> dict:
    """The span of two adjoining ones."""
    if not a["n"] or not b["n"]:
        ends = a["initials"] + b["initials"]
        border = 0
    else:
        ends = a["initials"][:1] + b["initials"][-1:]
        border = _illegal([a["initials"][-1], b["initials"][0]])
    turns = a["turns"] + b["turns"]
    shared = bool(a["turns"] and b["turns"] and a["turns"][1] == b["turns"][0])
    cell = joined(*({(s // 4, s % 4): (c, t) for s, c, t in zip(x["symbols"], x["costs"], x["audits"])} for x in (a, b)))
    sums = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated")}
    return sums | {"illegal": a["illegal"] + b["illegal"] + border, "initials": ends, "turns": turns[:1] + turns[-1:], "distinct": a["distinct"] + b["distinct"] - shared} | dict(zip(("symbols", "costs", "audits"), _told(cell)))


def _mapped(rows: DataFrame, columns: str, each) -> DataFrame:
    """each(row as dict) gives the rows, as tuples, that come of a row; one row is turned at a time."""

    def run(batches):
        batch_of = arrow_table(columns)
        for b in batches:
            for k in range(b.num_rows):
                out = each(b.slice(k, 1).to_pylist()[0])
                if out:
                    yield batch_of([list(c) for c in zip(*out)])

    return rows.mapInArrow(run, fields(columns))


def _repaired_pieces(pieces: DataFrame, fan: int) -> DataFrame:
    """Results of conversations that lie in pieces, one or many.

    First rows of equal role and text are found by an aggregate of digests; each piece makes the cells
    of its span, and fan adjoining spans are joined at a time, up to the whole. The audit is then cut
    along the pieces, whose repaired texts go, in order, through a task's checksum as they come: that
    checksum is the one thing that has to see a conversation's texts one after another.
    """
    at = Window.partitionBy("conv_id").orderBy("part", "piece")
    places = stored(pieces.select("conv_id", "part", "piece", (F.row_number().over(at) - 1).alias("place")), "conversation-places")  # a row for each piece
    firsts = pieces.select("conv_id", "part", "piece", F.posexplode("digests").alias("row", "digest")).groupBy("conv_id", "digest").agg(F.min(F.struct("part", "piece", "row")).alias("f"))
    fresh = firsts.groupBy("f.part", "f.piece").agg(F.collect_list("f.row").alias("fresh"))  # at most a piece's rows
    narrow = pieces.select("part", "piece", "initials", "flags", F.col("turns").alias("known")).join(fresh, ["part", "piece"], "left").join(places, ["part", "piece"])
    parser = Parser()
    columns = f"conv_id long, place long, {_SPAN}"
    names = [c.split()[0] for c in columns.split(", ")]
    first = lambda r: [(r["conv_id"], r["place"], *_one_span(r["initials"], r["flags"], r["known"], r["fresh"], parser))]
    spans = _mapped(narrow.select("conv_id", F.col("place").cast("long"), "initials", "flags", "known", F.expr("transform(fresh, r -> cast(r as long))").alias("fresh")), columns, first)

    def together(r: dict) -> list[tuple]:
        s = reduce(_joined_spans, r["spans"])
        return [(r["conv_id"], r["at"], *(s[n] for n in names[2:]))]

    longest = places.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0] + 1
    while longest > 1:
        longest = -(-longest // fan)
        grouped = spans.groupBy("conv_id", F.expr(f"place div {fan}").alias("at")).agg(F.sort_array(F.collect_list(F.struct("place", *names[2:]))).alias("spans"))  # at most fan
        spans = _mapped(grouped, columns, together)
    sizes = pieces.select("part", "piece", F.length("flags").alias("rows")).join(places, ["part", "piece"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "part", "piece", "rows"))).alias("cuts"))
    roots = spans.join(sizes.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")))

    def slices_of(r: dict) -> list[tuple]:
        cost, audit = answer({(s // 4, s % 4): (c, t) for s, c, t in zip(r["symbols"], r["costs"], r["audits"])})
        letters = np.frombuffer(audit.encode(), dtype=np.uint8)
        rows, used = np.flatnonzero(letters != ord("I")), np.concatenate(([0], np.cumsum(letters != ord("D"))))
        stops = np.cumsum([c["rows"] for c in r["cuts"]])
        # a piece's edits are its rows' and the insertions after each; those before all are the first piece's
        edges = [0, *(int(rows[s]) if s < len(rows) else len(letters) for s in stops[:-1]), len(letters)]
        gaps = _gaps(*r["turns"], r["distinct"]) if r["turns"] else 0
        told = (gaps, r["blank"], r["duplicate"], r["truncated"], r["illegal"], cost, audit)
        return [(r["conv_id"], c["part"], c["piece"], k, *(told if k == 0 else [None] * 7), audit[a:b], int(used[a]), has_system(audit)) for k, (c, a, b) in enumerate(zip(r["cuts"], edges, edges[1:]))]

    head = _RESULT.rsplit(", ", 1)[0]
    cut = f"conv_id long, part int, piece int, place long, {head.split(', ', 1)[1]}, edits string, used long, system boolean"
    parts = _mapped(roots, cut, slices_of).join(pieces.select("part", "piece", "roles", "texts"), ["part", "piece"])
    texts = f"{head}, place long, lines boolean, block string"

    def block(r: dict) -> list[tuple]:
        lines = repaired_lines(r["edits"], r["roles"], r["texts"], r["used"], r["system"])
        return [(*(r[c.split()[0]] for c in head.split(", ")), r["place"], bool(lines), "\n".join(lines))]

    def hashed(batches):
        batch_of, row, digest, lines = arrow_table(_RESULT), None, None, False
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                if r["place"] == 0:
                    if row:
                        yield batch_of([[v] for v in (*row, digest.hexdigest())])
                    row, digest, lines = [r[c.split()[0]] for c in head.split(", ")], hashlib.sha256(), False
                if r["lines"]:
                    digest.update((b"\n" if lines else b"") + r["block"].encode())
                    lines = True
        if row:
            yield batch_of([[v] for v in (*row, digest.hexdigest())])

    return _mapped(parts, texts, block).repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(hashed, fields(_RESULT))


def repair_conversations(rows: DataFrame, piece_rows: int = 20_000, piece_bytes: int = 4 << 20, fan: int = 8) -> DataFrame:
    """Finds each conversation's faults and the cheapest edits that give it the roles (s?(ua)+)?.

    rows are conv_id, turn, role, text and copies (as those of damaged; a row of no copies only tells
    that its conversation is there). Rows are ordered by turn, nulls first, then by role, by the text's
    first 32 characters and by a hash of it, so that ties and repeated rows have one order. A row's first fault counts: blank (nothing but white
    space), duplicate (role and text of an earlier row), truncated (the last sign is none of .!?). Keeping
    costs 0, another role 1, deleting 2 (blank and duplicate rows must go), inserting an empty row 5, and
    a truncated row that stays 5. Returns conv_id, gaps (turns missing between the least and greatest),
    blank, duplicate, truncated, illegal (neighbours whose initials are none of su, ua, au), cost, audit
    (initials of the cheapest edits, the least of equals) and repaired_sha256.

    Null conv_ids are one conversation. Conversations of no rows have no faults, no edits and the
    checksum of nothing. An empty table gives no rows. Conversations that lie within a partition of the
    ordered rows are done there; those at its ends, and those longer than a piece, in pieces.
    """
    gathered = stored(_gather(rows, piece_rows, piece_bytes), "conversations")
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return gathered.filter("whole").select(*names).unionByName(_repaired_pieces(gathered.filter("NOT whole"), fan))
