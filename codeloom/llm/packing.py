"""Packing along a Hilbert curve through hashed document vectors."""

from __future__ import annotations

from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_table, encoder, fields, mix, running_sums, slices, stored, texts_of, word_hashes, word_spans

#: Of the hashed word-count vectors.
BUCKETS = 1024

_CODED = "doc_id long, curve_key long, n_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows), bits to each of their coordinates.

    The transposed index is found bit plane by bit plane with reflections and axis exchanges,
    undone by a Gray code, and its bits are interleaved (J. Skilling, 2004).
    """
    x = np.array(points, dtype=np.int64).T.copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        q = 1 << plane
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << plane), (1 << plane) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> plane) & 1)
    return key


@lru_cache(maxsize=2)
def _signs(dims: int) -> np.ndarray:
    """Random signs for each bucket of the hashed vectors and each dimension."""
    spots = np.arange(BUCKETS * dims, dtype=np.uint64).reshape(BUCKETS, dims)
    return 1 - 2 * (mix(spots + np.uint64(1)) >> np.uint64(63)).astype(np.int64)


def project(texts: list[bytes], dims: int, bits: int) -> np.ndarray:
    """The documents' hashed word-count vectors, projected by random signs and cut to a grid.

    Roots of the counts are whole 256ths, so that sums are exact: a document's cell is the same
    whatever others are worked on with it, on every machine.
    """
    spots = np.zeros((len(texts), dims), dtype=np.int64)
    words = np.zeros(len(texts), dtype=np.int64)
    signs = _signs(dims)
    for k, text in enumerate(texts):
        starts, ends = word_spans(text)
        counts = np.bincount((word_hashes(text, starts, ends) >> np.uint64(54)).astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        spots[k] = np.floor(np.sqrt(counts[used]) * 256).astype(np.int64) @ signs[used]
        words[k] = len(starts)
    # a root is correctly rounded, so the last steps, one document's own, are the same everywhere too
    length = np.maximum(np.sqrt(words.astype(np.float64)), 1)
    return np.clip((spots / (256 * length[:, None]) / 3 + 0.5) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)


def pieces_of(start: int, n: int, total: int, length: int) -> list[tuple[int, int, int]]:
    """(sequence, offset in it, ids) of the pieces of ids start .. start + n - 1 of all.

    Full sequences of the given length come first. What is left of the total at the end is cut to
    powers of two, the largest first, so that nothing is padded.
    """
    full = total // length
    out, at, stop = [], start, start + n
    while at < min(stop, full * length):
        end = min(stop, (at // length + 1) * length)
        out.append((at // length, at % length, end - at))
        at = end
    sequence, begin = full, full * length
    while at < stop:
        size = 1 << ((total - begin).bit_length() - 1)
        if at < begin + size:
            end = min(stop, begin + size)
            out.append((sequence, at - begin, end - at))
            at = end
        begin, sequence = begin + size, sequence + 1
    return out


def pack_along_curve(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, dims: int = 4, bits: int = 10) -> DataFrame:
    """Packs the ids of all documents into sequences, neighbours on the curve side by side.

    Each whole text is encoded and end_id appended. Documents are ordered by their Hilbert key; the
    ids in that order, seen as one stream, are cut every length ids. Ids of a document therefore
    stay together but for the cuts, and nothing is padded. Returns doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id and offset for each piece.

    Ordering moves keys and counts only; a document's pieces follow from its place in the stream.
    Null texts count as empty: one id. Rows with a null or repeated doc_id are rows of their own;
    ties of the key are broken by doc_id and then by the row's place in the written table. An empty
    table gives no rows. Other columns are ignored.
    """

    def run(batches):
        coder, batch_of = encoder(tokenizer_path), arrow_table(_CODED)
        wide = "<u2" if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for b in slices(batches):
            texts = texts_of(b.column("text"))
            keys = hilbert_keys(project(texts, dims, bits), bits)
            ids = [np.append(np.frombuffer(x, dtype="<u4"), np.uint32(end_id)) for x in coder.encode(texts)]
            yield batch_of([b.column("doc_id"), keys, [len(x) for x in ids], [x.astype(wide).tobytes() for x in ids]])

    coded = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields(_CODED)).withColumn("_row", F.monotonically_increasing_id()), "packed-ids")
    narrow, total = running_sums(coded.select("curve_key", "doc_id", "_row", "n_tokens"), ["curve_key", "doc_id", "_row"], ["n_tokens"], "packed-order")
    stream = int(total["n_tokens"])

    def cut(batches):
        batch_of = arrow_table(_PIECES)
        for b in batches:
            rows = []
            for doc, n, raw, before in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids", "n_tokens_before"))):
                ids, at = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4"), 0
                for sequence, offset, size in pieces_of(before, n, stream, length):
                    rows.append((doc, at, size, crc32(ids[at : at + size].tobytes()), n, sequence, offset))
                    at += size
            if rows:
                yield batch_of([list(c) for c in zip(*rows)])

    return coded.select("_row", "doc_id", "n_tokens", "ids").join(narrow.select("_row", "n_tokens_before"), "_row").mapInArrow(cut, fields(_PIECES))
