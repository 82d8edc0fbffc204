"""Line differences between two versions of a text, pair by pair."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

_HUNK = "key long, hunk int, old_start int, old_lines int, new_start int, new_lines int"


def _common(old: list[str], new: list[str]) -> list[int]:
    """The length of the longest common subsequence of old and each prefix of new, by bit vectors: a
    zero bit marks where it grows."""
    where: dict[str, int] = {}
    for j, line in enumerate(new):
        where[line] = where.get(line, 0) | 1 << j
    full = grown = (1 << len(new)) - 1
    for line in old:
        met = grown & where.get(line, 0)
        grown = ((grown + met) | (grown - met)) & full
    out = [0]
    for bit in reversed(f"{grown:0{len(new)}b}" if new else ""):
        out.append(out[-1] + (bit == "0"))
    return out


def kept_lines(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: old is halved, new is split where both halves' common
    parts are longest together, so that memory is of the order of the lines."""
    out, open_ = [], [(0, len(old), 0, len(new))]
    while open_:
        a, b, c, d = open_.pop()
        while a < b and c < d and old[a] == new[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if b - a == 1:
            at = next((j for j in range(c, d) if new[j] == old[a]), None)
            out += [] if at is None else [(a, at)]
            continue
        mid = (a + b) // 2
        ahead, behind = _common(old[a:mid], new[c:d]), _common(old[mid:b][::-1], new[c:d][::-1])
        cut = max(range(d - c + 1), key=lambda j: ahead[j] + behind[d - c - j])
        open_ += [(a, mid, c, c + cut), (mid, b, c + cut, d)]
    return sorted(out)


def hunks(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(old start, old lines, new start, new lines) of the runs that differ; starts count from 1."""
    out, a, c = [], 0, 0
    for i, j in [*kept_lines(old, new), (len(old), len(new))]:
        if i > a or j > c:
            out.append((a + 1, i - a, c + 1, j - c))
        a, c = i + 1, j + 1
    return out


def line_diff(pairs: DataFrame) -> DataFrame:
    """Hunks of pairs (key, old_text, new_text); each pair is a row's own small work."""

    def run(frames):
        for f in frames:
            rows = [(key, n, p, c, q, m) for key, old, new in zip(f["key"], f["old_text"], f["new_text"]) for n, (p, c, q, m) in enumerate(hunks((old or "").split("\n"), (new or "").split("\n")))]
            yield pd.DataFrame(rows, columns=["key", "hunk", "old_start", "old_lines", "new_start", "new_lines"])

    return pairs.select("key", "old_text", "new_text").mapInPandas(run, _HUNK)
