"""Web archives of records that are compressed one by one with a dictionary of their own kind."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_table, fields, stored

#: Fixed values of the formats: magic numbers of a Zstandard frame and of the skippable frame that holds an
#: archive's dictionary.
FRAME, DICTIONARY_FRAME = b"\x28\xb5\x2f\xfd", b"\x5d\x2a\x4d\x18"

_ARCHIVES = "archive string, n_records long, data binary"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, stored_bytes long, url string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Records -----------------------------------------------------------------------------------------


def _header_line(name: str, value) -> bytes:
    """A header line; what would end it early is percent-encoded."""
    return f"{name}: {value}".replace("\r", "%0D").replace("\n", "%0A").encode() + b"\r\n"


def record(kind: str, headers: dict, block: bytes) -> bytes:
    lines = [_header_line(k, v) for k, v in {"WARC-Type": kind, **headers, "Content-Length": len(block)}.items() if v is not None]
    return b"".join((b"WARC/1.1\r\n", *lines, b"\r\n", block, b"\r\n\r\n"))


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, names in lower case, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's block is not as long as its header says")
    return headers, rest[:size]


def page_record(page_id: int | None, url: str | None, payload: bytes | None, sha: bytes, n_bytes: int | None, record_id: str, refers_to: tuple | None, date: str) -> bytes:
    """A response; or, without payload, a revisit of refers_to, (page_id, record id), with the same one."""
    n = n_bytes if payload is None else len(payload)
    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    headers = {"WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": date, "WARC-Target-URI": url, "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{base64.b32encode(sha).decode()}", "Page-Id": page_id}
    if payload is not None:
        return record("response", headers, answer + payload)
    page, its_record = refers_to
    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{its_record}>", "Refers-To-Page-Id": page}
    return record("revisit", headers, answer)


# Archives ----------------------------------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame that leads an archive, the dictionary compressed in it."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY_FRAME + struct.pack("<I", len(packed)) + packed


def frames(data: bytes, at: int = 0) -> Iterator[tuple[int, int]]:
    """Start and end of each frame, found by the headers of its blocks; nothing is decompressed."""
    while at < len(data):
        start, magic = at, data[at : at + 4]
        if magic != FRAME:
            if magic[1:] != DICTIONARY_FRAME[1:] or magic[0] >> 4 != 5:
                raise ValueError("not a frame")
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
        else:
            flags = data[at + 4]
            single, content = flags >> 5 & 1, (0, 2, 4, 8)[flags >> 6]
            at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (content or single)
            last = False
            while not last and at < len(data):
                block = int.from_bytes(data[at : at + 3], "little")
                last = bool(block & 1)
                at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a run of one byte is stored as that byte
            at += 4 * (flags >> 2 & 1)
        if at > len(data):
            raise ValueError("a frame is cut off")
        yield start, at


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, stored bytes, headers, block) of an archive's records."""
    reader = zstandard.ZstdDecompressor()
    for start, end in frames(data):
        if data[start : start + 4] == FRAME:
            yield start, end - start, *parsed(reader.decompress(data[start:end]))
        elif start == 0 and data[:4] == DICTIONARY_FRAME:
            raw = data[8:end]
            raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME else raw
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))


def train_dictionary(samples: list[bytes], size: int) -> bytes | None:
    """A dictionary of at most size bytes; None where there is too little to learn from."""
    if len(samples) < 16 or sum(map(len, samples)) < 2 * size:
        return None
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return None


def _uuid(digest: str, row: int) -> str:
    h = hashlib.md5(f"{digest}:{row}".encode()).hexdigest()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


# Pages -------------------------------------------------------------------------------------------


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    return stored(rows.select("*", F.unhex(F.sha1("payload")).alias("sha"), F.octet_length("payload").cast("long").alias("n")), "payloads")


def _with_first(rows: DataFrame, min_bytes: int, hot: int) -> DataFrame:
    """Adds first and first_page, row number and page_id of the response for the same payload.

    Only digests, ids and row numbers are aggregated. Digests of more than one in hot rows, fewer than
    hot of them, are broadcast, so that no task gets all rows of one; the others join by a shuffle.
    Payloads of rows that are known to be revisits stay behind.
    """
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row"))
    groups = rows.filter(F.col("n") >= min_bytes).groupBy("sha").agg(least.alias("least"), F.count("*").alias("rows")).filter("rows > 1")
    firsts = stored(groups.select("sha", F.col("least.row").alias("first"), F.col("least.page_id").alias("first_page"), "rows"), "first-payloads")
    bound = max(rows.count() // hot, 1)
    common = firsts.filter(F.col("rows") > bound).select("sha", F.col("first").alias("_first"), F.col("first_page").alias("_page"))
    tagged = rows.join(F.broadcast(common), "sha", "left")  # fewer than hot rows
    # a row that is done meets no one: its key is its number, of 8 bytes where digests have 20
    key = F.when(F.col("_first").isNull(), F.col("sha")).otherwise(F.unhex(F.lpad(F.hex("row"), 16, "0")))
    payload = F.when(F.coalesce(F.col("_first") == F.col("row"), F.lit(True)), F.col("payload")).alias("payload")
    rest = firsts.filter(F.col("rows") <= bound).select(F.col("sha").alias("_key"), "first", "first_page")
    joined = tagged.select("page_id", "url", payload, "row", "sha", "n", "_first", "_page", key.alias("_sought")).join(rest, F.col("_sought") == F.col("_key"), "left")
    return joined.select("page_id", "url", "payload", "row", "sha", "n", F.coalesce("_first", "first", "row").alias("first"), F.coalesce("_page", "first_page").alias("first_page"))


def page_dictionary(rows: DataFrame, records: int, record_bytes: int, size: int, date: str) -> bytes | None:
    """A dictionary from a bounded sample: of the different payloads of at most record_bytes, so many
    with the least hashes of their digests. One task builds it."""
    narrow = rows.filter(F.col("n").between(1, record_bytes)).groupBy("sha").agg(F.min("row").alias("row"))
    chosen = narrow.orderBy(F.xxhash64("sha"), "sha").limit(records).select("row")
    sample = rows.join(F.broadcast(chosen), "row").select("page_id", "url", "payload", "sha")  # records rows

    def run(batches):
        blocks = [(bytes(r["sha"]), page_record(r["page_id"], r["url"], r["payload"], r["sha"], None, _uuid(r["sha"].hex(), 0), None, date)) for b in batches for r in b.to_pylist()]
        found = train_dictionary([block for _, block in sorted(blocks)], size)
        yield arrow_table("dictionary binary")([[found]])

    row = sample.coalesce(1).mapInArrow(run, fields("dictionary binary")).first()  # none if there are no pages
    return row and row[0]


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 4 << 20, level: int = 3, hot: int = 1000, sample_records: int = 1000, sample_record_bytes: int = 32 << 10, dictionary_bytes: int = 64 << 10, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each page and returns the archives: archive (a file name), n_records, data.

    Of pages whose payloads, the html's UTF-8 bytes, are equal and of at least min_bytes, that with the
    smallest page_id is a response and the others revisit it; all smaller ones are responses. Each
    archive starts with a dictionary in a skippable frame, then has a warcinfo record and the pages'
    records, each a frame of its own. The dictionary comes from the sample that page_dictionary
    describes, where that holds enough to learn from. Archives are rows of a Parquet table in the shared
    folder; save_archives makes files of them.

    A null html is an empty payload, a null url has no Target-URI. Null page_ids count as the largest,
    and the first of repeated rows is the response. An empty table gives no archives. Other columns are
    ignored, whatever their names.
    """
    rows = _payloads(pages)
    dictionary = page_dictionary(rows, sample_records, sample_record_bytes, dictionary_bytes, date)

    def run(batches):
        part, batch_of = TaskContext.get().partitionId(), arrow_table(_ARCHIVES)
        lead, extra = b"", {}
        if dictionary:
            prepared = zstandard.ZstdCompressionDict(bytes(dictionary))
            prepared.precompute_compress(level=level)
            lead, extra = dictionary_frame(bytes(dictionary)), {"dict_data": prepared}
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True, **extra)
        out, size, n, number = [], 0, 0, 0
        for b in batches:
            for page, url, payload, row, sha, n_bytes, first, first_page in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "row", "sha", "n", "first", "first_page"))):
                if not out:
                    name = f"part-{part:05d}-{number:05d}.warc.zst"
                    about = b"software: codeloom\r\nformat: WARC File Format 1.1\r\n"
                    info = {"WARC-Record-ID": f"<urn:uuid:{_uuid(name, 0)}>", "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}
                    out, size, n = [lead, packer.compress(record("warcinfo", info, about))], len(lead), 0
                if first == row:
                    data = page_record(page, url, payload or b"", sha, None, _uuid(sha.hex(), row), None, date)
                else:
                    data = page_record(page, url, None, sha, n_bytes, _uuid(sha.hex(), row), (first_page, _uuid(sha.hex(), first)), date)
                out.append(packer.compress(data))
                size, n = size + len(out[-1]), n + 1
                if size >= archive_bytes:
                    yield batch_of([[name], [n], [b"".join(out)]])
                    out, number = [], number + 1
        if out:
            yield batch_of([[name], [n], [b"".join(out)]])

    return stored(_with_first(rows, min_bytes, hot).mapInArrow(run, fields(_ARCHIVES)), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each page's record: page_id, payload_bytes, payload_digest (bare, both of the full
    payload, which is checked where it is there), record_type, refers_to, archive, offset, stored_bytes
    and url."""

    def rows_of(name: str, data: bytes):
        for offset, size, headers, block in read_records(data):
            kind = headers["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            head, _, payload = block.partition(b"\r\n\r\n")
            digest = headers["warc-payload-digest"].removeprefix("sha1:")
            n = int(next(line for line in head.split(b"\r\n") if line.startswith(b"Content-Length:"))[15:])
            if kind == "response" and (len(payload) != n or sha1_base32(payload) != digest):
                raise ValueError("a payload is not what its headers say")
            ids = (int(headers[k]) if k in headers else None for k in ("page-id", "refers-to-page-id"))
            page, refers = ids
            yield page, n, digest, kind, refers, name, offset, size, headers.get("warc-target-uri")

    def run(batches):
        batch_of = arrow_table(_READ)
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                out = list(rows_of(row.column("archive")[0].as_py(), row.column("data")[0].as_py()))
                for at in range(0, len(out), 10_000):
                    yield batch_of([list(c) for c in zip(*out[at : at + 10_000])])

    return archives.select("archive", "data").mapInArrow(run, fields(_READ))


def save_archives(archives: DataFrame, folder: str) -> None:
    """Makes files of the archives in a folder that all machines have mounted. A file appears whole."""
    import os

    os.makedirs(folder, exist_ok=True)

    def run(batches):
        from uuid import uuid4

        for b in batches:
            for name, data in zip(b.column("archive").to_pylist(), b.column("data").to_pylist()):
                part = os.path.join(folder, f".{uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(folder, name))
            yield arrow_table("n long")([[b.num_rows]])

    archives.select("archive", "data").mapInArrow(run, fields("n long")).agg(F.sum("n")).collect()
