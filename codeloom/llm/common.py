"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window

from codeloom.tables import stored

_ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow_schema(columns: str) -> pa.Schema:
    """An Arrow schema from "name type, ..."; types are plain ones, array<type> and struct<name:type,...>."""

    def kind(text: str) -> pa.DataType:
        if text.startswith("array<"):
            return pa.list_(kind(text[6:-1]))
        if text.startswith("struct<"):
            return pa.struct([(n, kind(t)) for n, t in (x.split(":", 1) for x in text[7:-1].split(","))])
        return _ARROW[text]

    return pa.schema([(n, kind(t)) for n, t in (x.split(" ", 1) for x in columns.split(", "))])


def fields(columns: str) -> T.StructType:
    return from_arrow_schema(arrow_schema(columns))


def arrow_table(columns: str):
    """A function that makes record batches of this schema from lists of columns."""
    schema = arrow_schema(columns)
    return lambda values: pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(values, schema.types)], schema=schema)


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches, max_bytes: int = 8 << 20, column: str = "text"):
    """The same rows in record batches whose texts hold about max_bytes, for bounded memory."""
    for batch in batches:
        size = batch.column(column).nbytes
        rows = max(1, int(batch.num_rows * max_bytes / max(size, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# Words -----------------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return series(_BASE), series(_BASE_INVERSE)


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+ of the bytes."""
    word = np.zeros(len(text) + 2, dtype=np.int8)
    np.logical_not(_SPACE[np.frombuffer(text, dtype=np.uint8)], out=word[1:-1].view(bool))
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from polynomial prefix sums over the bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    size = 1 << max(16, int(len(text)).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[np.frombuffer(text, dtype=np.uint8)] * power[: len(text)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive values; needs len(hashes) >= k >= 1."""
    out = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[i : len(hashes) - k + 1 + i]
    return mix(out)


# Prefix sums over an order ----------------------------------------------------------------------


def running_sums(rows: DataFrame, order: list[str], measures: list[str], name: str) -> tuple[DataFrame, dict[str, int]]:
    """Adds <measure>_before, the sum over all rows before this one in the given order, and
    row_before, the number of such rows. Also returns the totals.

    rows should be narrow: they are range-partitioned and written. Totals of the partitions, one
    row each, give the partitions' offsets; within a partition a window adds up. The order must be
    total up to rows that are alike. Nulls come first in the order; a null measure adds nothing. An empty
    table gives no rows and totals of 0.
    """
    placed = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_rows"), *(F.sum(m).alias(f"_{m}") for m in measures))
    sums = ["rows", *measures]
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", *(F.coalesce(F.sum(f"_{m}").over(before), F.lit(0)).alias(f"_{m}_offset") for m in sums))
    inside = Window.partitionBy("_part").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(offsets), "_part")  # a row for each partition
    for m in measures:
        out = out.withColumn(f"{m}_before", F.col(f"_{m}_offset") + F.coalesce(F.sum(m).over(earlier), F.lit(0)))
    out = out.withColumn("row_before", F.col("_rows_offset") + F.row_number().over(inside) - 1)
    total = parts.agg(*(F.coalesce(F.sum(f"_{m}"), F.lit(0)).alias(m) for m in sums)).first()
    return out.drop("_part", *(f"_{m}_offset" for m in sums)), total.asDict()


# Tokenizers -------------------------------------------------------------------------------------

#: White space other than space and line feed, and what special tokens' strings start with. A text with any is encoded whole.
_ODD_BYTES = (b"\t", b"\v", b"\f", b"\r", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"<|")
_ODD = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_GAP = np.zeros(256, dtype=bool)
_GAP[[10, 32]] = True
_ASCII = np.arange(256) < 128
_LETTER_OR_DIGIT = np.array([chr(c).isalnum() for c in range(256)]) & _ASCII
_SIGN = np.array([chr(c).isprintable() for c in range(256)]) & _ASCII & ~_LETTER_OR_DIGIT & ~_GAP
#: Second bytes, after 0xC3, of the letters from U+00C0 to U+00FF.
_LATIN = np.array([0x80 <= c < 0xC0 and c not in (0x97, 0xB7) for c in range(256)])


def cuts_of(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start that lie one after another in data, bytes of UTF-8.

    No pre-token of the tokenizers in use holds a space or line feed after another character, or a
    letter or digit before a sign. So a text is cut before each run of spaces and line feeds, and
    before an ASCII sign that follows an ASCII letter or digit or a letter of Latin-1. The ids of a
    text are those of its pieces, each encoded as it stands.
    """
    gap, letter, ends = _GAP[data], _LETTER_OR_DIGIT[data], np.cumsum(sizes)
    letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = (gap[1:] & ~gap[:-1]) | (_SIGN[data[1:]] & letter[:-1])
    cut[(ends - sizes)[sizes > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Whole texts to token ids by the tokenizers library, with a memo of at most memo_pieces pieces, of
    which those that came again stay when it is full.

    path is that of a tokenizer's file, or the name of one that this machine's public_tokenizers has.
    """

    def __init__(self, path: str, memo_pieces: int = 500_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path if os.path.isabs(path) else public_tokenizers.path(path))
        self.memo_pieces = memo_pieces
        self._forget()
        # by id, whether a token ends a word, or begins one after a space; one of them, as the vocabulary marks it
        vocab = self.tokenizer.get_vocab()
        flags = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.word_ends = any(t.endswith("</w>") for t in vocab)
        flags[[i for t, i in vocab.items() if (t.endswith("</w>") if self.word_ends else t.startswith("\u0120"))]] = True
        self.flags = flags

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}  # the number of a piece, under which its ids are found
        self.ids, self.used = np.zeros(1 << 16, dtype=np.uint32), 0  # all pieces' ids, one after another
        self.places = np.zeros((2, 1 << 14), dtype=np.int64)  # by number of piece, start and number of its ids
        self.again = np.zeros(1 << 14, dtype=bool)  # by number of piece, whether it came again

    def _make_room(self) -> None:
        """Forgets pieces that did not come again; all, if that leaves more than half of what fits."""
        stay = np.flatnonzero(self.again[: len(self.memo)])
        names = list(self.memo) if len(stay) <= self.memo_pieces // 2 else []
        stay = stay if names else stay[:0]
        starts, counts = self.places[:, stay]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(starts - ends + counts, counts) + np.arange(int(counts.sum()))]
        self._forget()
        self._keep([names[k] for k in stay.tolist()], ids, ends - counts, ends)

    def _keep(self, pieces: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Notes pieces whose ids are ids[start:end]."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        first, last = len(self.memo), len(self.memo) + len(pieces)
        if last > self.places.shape[1]:
            self.places = np.concatenate((self.places, np.zeros((2, max(last, self.places.shape[1])), dtype=np.int64)), axis=1)
            self.again = np.concatenate((self.again, np.zeros(self.places.shape[1] - len(self.again), dtype=bool)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.places[:, first:last] = starts + self.used, ends - starts
        self.memo.update(zip(pieces, range(first, last)))
        self.used += len(ids)

    def _learn_words(self, pieces: list[bytes]) -> bool:
        """Encodes pieces of a space and letters as one text and cuts its ids by their marks; false if
        there are not as many marks as pieces."""
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join(pieces).decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
        at = np.flatnonzero(self.flags[ids])
        cuts = np.append(0, at + 1) if self.word_ends else np.append(at, len(ids))
        if len(cuts) != len(pieces) + 1 or cuts[0] != 0 or cuts[-1] != len(ids):
            return False
        self._keep(pieces, ids, cuts[:-1], cuts[1:])
        return True

    def _learn(self, pieces: list[bytes]) -> None:
        """Encodes all the pieces as one text and cuts its ids by their places in it."""
        joined, real, starts, ends, at = [], [], [], [], 0
        for raw in pieces:
            piece = raw.decode()
            if not piece.strip(" \n"):
                ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype=np.uint32)
                self._keep([raw], ids, np.array([0]), np.array([len(ids)]))
                continue
            if piece[0] not in " \n":
                joined.append("\n")
                at += 1
            joined.append(piece)
            real.append(raw)
            starts.append(at)
            at += len(piece)
            ends.append(at)
        code = self.tokenizer.encode("".join(joined), add_special_tokens=False)
        begin = np.fromiter((a for a, _ in code.offsets), dtype=np.int64, count=len(code.ids))
        self._keep(real, np.array(code.ids, dtype=np.uint32), np.searchsorted(begin, starts), np.searchsorted(begin, ends))

    def _learn_all(self, pieces: list[bytes]) -> None:
        words, other = [], []
        for p in pieces:
            (words if p[0] == 32 and (p[1:].isalpha() or p[1:].decode().isalpha()) else other).append(p)
        for i in range(0, len(words), 500):
            if not self._learn_words(words[i : i + 500]):
                other += words[i : i + 500]
        for i in range(0, len(other), 500):
            self._learn(other[i : i + 500])

    def _encode_cut(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts by their pieces. Equal pieces are found by Arrow's dictionary encoding, so
        each is looked up once for all texts."""
        data, sizes = b"".join(texts), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        if not data:
            return [b""] * len(texts)
        cuts = cuts_of(np.frombuffer(data, dtype=np.uint8), sizes)
        places = pa.py_buffer(np.append(cuts, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(cuts), [None, places, pa.py_buffer(data)]).dictionary_encode()
        _, edges, raw = coded.dictionary.buffers()
        edges, raw = np.frombuffer(edges, dtype=np.int32)[: len(coded.dictionary) + 1].tolist(), raw.to_pybytes()
        pieces = [raw[a:b] for a, b in zip(edges, edges[1:])]
        if len(self.memo) > self.memo_pieces:
            self._make_room()
        numbers = list(map(self.memo.get, pieces))
        new = [k for k, n in enumerate(numbers) if n is None]
        self.again[np.array([n for n in numbers if n is not None], dtype=np.int64)] = True
        if new:
            self._learn_all([pieces[k] for k in new])
            for k in new:
                numbers[k] = self.memo[pieces[k]]
        starts, counts = self.places[:, np.array(numbers)[coded.indices.to_numpy(zero_copy_only=False)]]
        before = np.cumsum(counts) - counts
        raw = self.ids[np.repeat(starts - before, counts) + np.arange(int(counts.sum()))].astype("<u4", copy=False).tobytes()
        ends = np.cumsum(sizes)
        first, stop = np.searchsorted(cuts, ends - sizes), np.searchsorted(cuts, ends)
        edge = np.append(before, len(raw) // 4) * 4
        return [raw[a:b] for a, b in zip(edge[first].tolist(), edge[stop].tolist())]

    def encode(self, texts: list[bytes], part_bytes: int = 4 << 20) -> list[bytes]:
        """The ids of each text, UTF-8, as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        part, size = [], 0
        for k, raw in enumerate(texts):
            if any(x in raw for x in _ODD_BYTES) or (not raw.isascii() and _ODD.search(raw.decode())):
                out[k] = np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            part.append(k)
            size += len(raw)
            if size >= part_bytes:
                for j, ids in zip(part, self._encode_cut([texts[j] for j in part])):
                    out[j] = ids
                part, size = [], 0
        for j, ids in zip(part, self._encode_cut([texts[j] for j in part])):
            out[j] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget_encoders() -> None:
    """Gives back what earlier tasks keep in this worker, which lives on between stages: encoders, and
    memory that was freed but stays with the process."""
    import ctypes
    import gc

    encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# Documents --------------------------------------------------------------------------------------


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(column: Column | str) -> Column:
    """Bytes of a text column, none for null."""
    return F.encode(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), "UTF-8")
