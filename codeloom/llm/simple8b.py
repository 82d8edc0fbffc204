"""Simple-8b: integers in 64-bit words, as many to a word as its widest allows."""

from __future__ import annotations

import numpy as np

#: Selector s, in the top four bits, says: PACKINGS[s - 1] = (integers in the word, bits of each). Selector 0 is an escape: the next word is one integer of 64 bits.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNTS = np.array([1] + [c for c, _ in PACKINGS] + [0], dtype=np.int64)


def _windows_all(ok: np.ndarray, size: int) -> np.ndarray:
    """For each start, whether the size values from there on are all true; false past the end."""
    out, have = ok, 1
    while have < size:
        step = min(have, size - have)
        shifted = np.zeros_like(out)
        shifted[:-step] = out[step:] if step < len(out) else False
        out, have = out & shifted, have + step
    return out


def pack(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packs lists of unsigned integers that lie one after another in values.

    Returns the words and the number of words of each list; each list starts a word of its own.
    """
    values = np.asarray(values, dtype=np.uint64)
    lengths = np.asarray(lengths, dtype=np.int64)
    n = len(values)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(lengths), dtype=np.int64)
    ends = np.cumsum(lengths)
    room = np.repeat(ends, lengths) - np.arange(n)
    selector = np.zeros(n, dtype=np.uint8)
    for s in range(len(PACKINGS), 0, -1):  # what fits with more integers also fits with fewer
        count, bits = PACKINGS[s - 1]
        if count > n:
            break
        fits = _windows_all(values < np.uint64(1 << bits), count) & (room >= count)
        if not fits.any():
            break
        selector[fits] = s
    step = _COUNTS[selector].astype(np.uint8).tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts, dtype=np.int64)
    chosen = selector[at]
    escaped = chosen == 0
    place = np.arange(len(at)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(at) + int(escaped.sum()), dtype=np.uint64)
    for s in np.unique(chosen).tolist():
        rows = np.flatnonzero(chosen == s)
        if s == 0:
            words[place[rows] + 1] = values[at[rows]]
            continue
        count, bits = PACKINGS[s - 1]
        word = np.full(len(rows), s << 60, dtype=np.uint64)
        for j in range(count):
            word |= values[at[rows] + j] << np.uint64(bits * j)
        words[place[rows]] = word
    sizes = 1 + escaped.astype(np.int64)
    owner = np.searchsorted(ends, at, side="right")
    return words, np.bincount(owner, weights=sizes, minlength=len(lengths)).astype(np.int64)


def unpack(words: np.ndarray) -> np.ndarray:
    """The integers of the words, in order."""
    words = np.asarray(words, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selector]
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(selector == 0).tolist():
        if not raw[i]:
            raw[i + 1] = True
    heads = np.flatnonzero((selector == 0) & ~raw)
    counts[heads] = 0
    counts[raw] = 1
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    out[at[raw]] = words[raw]
    for s in np.unique(selector[~raw]).tolist():
        if s == 0:
            continue
        count, bits = PACKINGS[s - 1]
        rows = np.flatnonzero((selector == s) & ~raw)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count):
            out[at[rows] + j] = (words[rows] >> np.uint64(bits * j)) & mask
    return out
