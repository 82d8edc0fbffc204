"""Media columns: ISO media containers, written and walked without decoding their payload."""

from __future__ import annotations

import hashlib
import struct
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_table, fields, slices, stored, texts_of

#: Boxes that hold boxes; meta and others with content of their own are not walked.
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"udta"}
_INFO = "codec string, handler string, timescale long, duration long, seconds double, n_samples long, sample_bytes long, channels int, sample_rate int, n_keyframes long, keyframes array<struct<sample:long,start:long,end:long>>, error string"


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_container(payload: bytes, unit: int = 576, rate: int = 8000, samples_per_chunk: int = 8, keyframe_every: int = 8) -> bytes:
    """An ISO media file with one mono audio track of raw 8-bit samples.

    Each media sample holds unit bytes, that is unit audio frames at the given rate; the payload's
    length must be a multiple of unit. Every keyframe_every-th media sample is marked as a sync
    sample, and chunks hold samples_per_chunk of them.
    """
    n, left = divmod(len(payload), unit)
    if left or not n:
        raise ValueError(f"the payload must be a positive multiple of {unit} bytes")
    frames = n * unit
    full, rest = divmod(n, samples_per_chunk)
    runs = ([(1, samples_per_chunk)] if full else []) + ([(full + 1, rest)] if rest else [])
    chunks = full + bool(rest)
    syncs = range(1, n + 1, keyframe_every)
    entry = _box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, rate << 16))

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (samples_per_chunk * unit)
        wide = first + frames > 0xFFFFFFFF
        tables = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">3I", 1, n, unit)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", c, k, 1) for c, k in runs)),
            _full(b"stsz", struct.pack(">2I", unit, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
            _full(b"stss", struct.pack(">I", len(syncs)), np.array(syncs, dtype=">u4").tobytes()),
        )
        # version 0 headers hold durations of 32 bits: some 4 GB of payload
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">4I2H", 0, 0, rate, frames, 0x55C4, 0)),
            _full(b"hdlr", struct.pack(">I4s12s", 0, b"soun", bytes(12)), b"sound\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables),
        )
        track = _full(b"tkhd", struct.pack(">5I8x4H", 0, 0, 1, 0, frames, 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7)
        return _box(b"moov", _full(b"mvhd", struct.pack(">4IiH10x", 0, 0, rate, frames, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2)), _box(b"trak", track, media))

    start = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isommp41")
    head = len(start) + len(moov(0)) + 8
    return b"".join((start, moov(head), struct.pack(">I4s", 8 + len(payload), b"mdat"), payload))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, start of the content, end) of every box, parents before children.

    Sizes of 64 bits and sizes that reach to the end are read; a box that leaves its parent is an
    error.
    """
    end = len(data) if end is None else end
    while start < end:
        if start + 8 > end:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} has a wrong size")
        yield (*path, kind), start + head, start + size
        if kind in _NESTED:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def read_tracks(data: bytes) -> list[dict]:
    """For each track its codec, handler, times and the place of every sample (arrays offsets,
    sizes, and sync, the numbers of the sync samples counted from 0)."""
    tracks: list[dict] = []
    for path, a, b in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"codec": "", "handler": "", "timescale": 0, "duration": 0, "channels": 0, "rate": 0, "sync": None})
        if not tracks or path[:2] != (b"moov", b"trak"):
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">2I", data, a + 12)
        elif kind == b"hdlr" and path[2] == b"mdia":
            t["handler"] = data[a + 8 : a + 12].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = data[a + 12 : a + 16].decode("latin-1")
            if t["handler"] == "soun":
                t["channels"], t["rate"] = struct.unpack_from(">H", data, a + 32)[0], struct.unpack_from(">I", data, a + 40)[0] >> 16
        elif kind in (b"stts", b"stsc", b"stco", b"co64", b"stss"):
            n = struct.unpack_from(">I", data, a + 4)[0]
            width = {b"stts": 2, b"stsc": 3}.get(kind, 1)
            table = np.frombuffer(data, dtype=">u8" if kind == b"co64" else ">u4", count=n * width, offset=a + 8).astype(np.int64)
            t["stco" if kind == b"co64" else kind.decode()] = table.reshape(-1, width) if width > 1 else table
        elif kind == b"stsz":
            size, n = struct.unpack_from(">2I", data, a + 4)
            t["sizes"] = np.full(n, size, dtype=np.int64) if size else np.frombuffer(data, dtype=">u4", count=n, offset=a + 12).astype(np.int64)
    for t in tracks:
        sizes, chunks, runs = t.get("sizes", np.zeros(0, np.int64)), t.get("stco", np.zeros(0, np.int64)), t.get("stsc", np.zeros((0, 3), np.int64))
        lasts = np.append(runs[1:, 0], len(chunks) + 1) if len(runs) else np.zeros(0, np.int64)
        per_chunk = np.repeat(runs[:, 1], lasts - runs[:, 0]) if len(runs) else np.zeros(0, np.int64)
        if per_chunk.sum() != len(sizes) or len(per_chunk) != len(chunks):
            raise ValueError("the sample tables do not agree")
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(per_chunk) - per_chunk
        t["sizes"] = sizes
        t["offsets"] = np.repeat(chunks, per_chunk) + before - np.repeat(before[np.minimum(first, max(len(sizes) - 1, 0))] if len(sizes) else first, per_chunk)
        t["sync"] = t["stss"] - 1 if "stss" in t else np.arange(len(sizes))
        if len(sizes) and (t["offsets"] + sizes).max() > len(data):
            raise ValueError("a sample lies outside of the file")
    return tracks


def read_payload(data: bytes, track: dict) -> bytes:
    """The bytes of all samples of a track, joined chunk by chunk where they adjoin."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts, ends = offsets[np.append(0, breaks)], (offsets + sizes)[np.append(breaks - 1, len(offsets) - 1)]
    return b"".join(data[s:e] for s, e in zip(starts.tolist(), ends.tolist()))


def _info(data: bytes) -> tuple:
    try:
        tracks = read_tracks(data)
        if not tracks:
            raise ValueError("no track")
        t = tracks[0]
        keys = [{"sample": int(s), "start": int(t["offsets"][s]), "end": int(t["offsets"][s] + t["sizes"][s])} for s in t["sync"].tolist()]
        return (t["codec"], t["handler"], t["timescale"], t["duration"], t["duration"] / max(t["timescale"], 1), len(t["sizes"]), int(t["sizes"].sum()), t["channels"], t["rate"], len(keys), keys, None)
    except (ValueError, IndexError, struct.error) as e:
        return (*[None] * 11, str(e))


def media_columns(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Codec, duration and keyframe byte ranges of the first track of each container.

    Only boxes and sample tables are read. A value that is null, empty or no container gives nulls
    and a message in error. Each row has its own result, so rows with a null or repeated key all stay;
    an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    schema = f"key {dict(files.dtypes)[key]}, {_INFO}"

    def run(batches):
        batch_of = arrow_table(schema)
        for b in slices(batches, column="media"):
            rows = [_info(x or b"") for x in b.column("media").to_pylist()]
            yield batch_of([b.column("key"), *map(list, zip(*rows))])

    return files.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(run, fields(schema)).withColumnRenamed("key", key)


def store_texts(docs: DataFrame, unit: int = 576) -> DataFrame:
    """Writes each text as a container, in a Parquet table with a media column.

    Returns doc_id, n_bytes and media, read back. The payload is the text's UTF-8 bytes and bytes
    255 up to a positive multiple of unit. Null texts count as empty. Rows are stored one by one, so rows
    without or with a repeated doc_id all stay, and equal texts have equal containers. An empty table
    gives no rows. Other columns are ignored.
    """
    schema = "doc_id long, n_bytes long, media binary"

    def run(batches):
        batch_of = arrow_table(schema)
        for b in slices(batches):
            texts = texts_of(b.column("text"))
            yield batch_of([b.column("doc_id"), [len(t) for t in texts], [write_container(t + b"\xff" * ((-len(t)) % unit if t else unit), unit) for t in texts]])

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields(schema)), "media")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(files: DataFrame) -> DataFrame:
    """Reads the payload of stored texts through the sample tables and digests it.

    The feature names codec, rate, seconds, samples, and the keyframes' number and byte ranges'
    checksum. Rows with a null doc_id or repeated rows are treated as any other; an empty table
    gives no rows.
    """

    def run(batches):
        batch_of = arrow_table(_DIGEST)
        for b in slices(batches, column="media"):
            rows = []
            for doc, n, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                t = read_tracks(data)[0]
                payload = read_payload(data, t)
                s = t["sync"]
                ranges = np.column_stack((t["offsets"][s], t["offsets"][s] + t["sizes"][s])).astype("<i8")
                feature = f"codec={t['codec'].strip()};rate={t['rate']};channels={t['channels']};seconds={t['duration'] / t['timescale']:.3f};samples={len(t['sizes'])};keyframes={len(s)};first={ranges[0, 0]}-{ranges[0, 1]};ranges={crc32(ranges.tobytes()):08x}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            if rows:
                yield batch_of([list(c) for c in zip(*rows)])

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, fields(_DIGEST))
