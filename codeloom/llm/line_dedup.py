"""Removal of lines that an earlier line equals or nearly equals, by a segment-partition edit join."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from .common import arrow_table, fields, forget_encoders, free_name, slices, stored, texts_of

#: Up to so many candidate lines, their hashes are broadcast to fetch the lines.
BROADCAST_LINES = 1_000_000
#: Lines of one key that are compared with each other in one go, and their bytes, on average.
BLOCK, BLOCK_BYTES = 1024, 1 << 20
#: A key with this share of a batch's rows, and HOT_ROWS of them, is hot; its rows are dealt to so many salts.
HOT_SHARE, HOT_ROWS, SALTS = 1 / 1000, 64, 1024

_SEEDS = "key long, line long, salt long"
_JUDGED = "h1 long, h2 long, links long, late boolean"
_DONE = "doc_id long, th long, n_lines long, n_removed long, n_links long, kept_sha256 string, kept binary"
_BLANK = " \t\r"


@lru_cache(maxsize=100_000)
def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line; the last ones are longer by one."""
    size, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        n = size + (i >= edits + 1 - longer)
        out.append((at, n))
        at += n
    return out


@lru_cache(maxsize=100_000)
def probes(length: int, edits: int) -> list[tuple[int, int, int]]:
    """(seed, start, end) of the substrings to look up for lines no longer than this one.

    For an indexed line shorter by d, segment i can only match where i - 1 edits before it and
    edits + 1 - i after it still make up for the shift; other places can be left out, as another
    segment then matches.
    """
    out = []
    for d in range(edits + 1):
        if length - d < edits + 1:
            break
        for i, (p, n) in enumerate(segments(length - d, edits)):
            after = edits - i
            for at in range(max(0, p - i, p + d - after), min(length - n, p + i, p + d + after) + 1):
                out.append(((length - d) * 16 + i, at, at + n))
    return out


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most edits, by a band of a bit-parallel table.

    Equal ends are cut first. The band's vertical differences are in two bit vectors of
    2 * edits + 1 bits that move down a row with every column (H. Hyyro, 2003).
    """
    if abs(len(a) - len(b)) > edits:
        return False
    start, m, n = 0, len(a), len(b)
    while start < m and start < n and a[start] == b[start]:
        start += 1
    while m > start and n > start and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[start:m], b[start:n]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    m, n = len(a), len(b)
    width = 2 * edits + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    # bit r of column j stands for row j - edits + r (from 1); rows before the first add nothing
    plus, minus = (mask << edits) & mask, 0
    score = min(edits, m)  # at the band's lowest row, or the last one
    for j in range(1, n + 1):
        low = j - edits - 1  # the band's first row, from 0
        match = where.get(b[j - 1], 0)
        match = (match >> low if low >= 0 else match << -low) & mask
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & mask
        up, down = minus | (~(diagonal | plus) & mask), diagonal & plus
        if j + edits <= m:
            score += not diagonal & top
        else:
            bit = 1 << (width - 1 - (j + edits - m))
            score += bool(up & bit) - bool(down & bit)
        shifted = diagonal >> 1
        plus, minus = down | (~(shifted | up) & mask), shifted & up
    return score <= edits


def _near_lines(text: str, min_chars: int) -> list[str]:
    return [x for x in text.split("\n") if len(x) >= min_chars and x.strip(_BLANK)]


def _parities(lines: list[str]) -> np.ndarray:
    """One bit for each of 31 classes of characters, set if their number in the line is odd. An edit
    flips two bits at most."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    bits = np.int32(1) << (codes * np.uint64(0x9E3779B1) % np.uint64(31)).astype(np.int32)
    sizes = np.array([len(x) for x in lines])
    return np.bitwise_xor.reduceat(bits, np.cumsum(sizes) - sizes)


def _salts(keys: np.ndarray, lines: np.ndarray, hot_rows: int) -> np.ndarray:
    """0, but from 1 on by line where the key is hot in this batch; two rows of every such key keep 0."""
    out = np.zeros(len(keys), dtype=np.int64)
    counted = pc.value_counts(pa.array(keys))
    many = counted.field("values").to_numpy()[counted.field("counts").to_numpy() >= max(hot_rows, HOT_SHARE * len(keys))]
    for k in many.tolist():
        at = np.flatnonzero(keys == k)[2:]
        out[at] = 1 + lines[at] % SALTS
    return out


def _seed_rows(docs: DataFrame, edits: int, min_chars: int, hot_rows: int) -> DataFrame:
    """Hashes of the probing substrings of every line, once in each task; a line's own segments are
    among them."""

    def run(batches):
        forget_encoders()
        batch_of = arrow_table(_SEEDS)
        seen: set[int] = set()
        for b in slices(batches, 2 << 20):
            hashes, keys, counts = [], [], []
            for text in b.column("text").to_pylist():
                for line in _near_lines(text or "", min_chars):
                    raw = line.encode()
                    h = xxh64_intdigest(raw, 42)
                    if h in seen:
                        continue
                    seen.add(h)
                    n = len(line)
                    wanted = probes(n, edits)
                    own = {xxh64_intdigest(raw[s:e], k) for k, s, e in wanted} if len(raw) == n else {xxh64_intdigest(line[s:e].encode(), k) for k, s, e in wanted}
                    keys += own
                    hashes.append(h)
                    counts.append(len(own))
            if len(seen) > 1_000_000:
                seen.clear()
            if keys:
                found, owners = np.array(keys, dtype=np.uint64).view(np.int64), np.repeat(np.array(hashes, dtype=np.uint64).view(np.int64), counts)
                yield batch_of([found, owners, _salts(found, owners, hot_rows)])

    return docs.select("text").mapInArrow(run, fields(_SEEDS))


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line that is not blank: doc_id, th (hash of the text), at, line, h1, h2."""
    lines = docs.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    full = lines.filter(F.btrim("line", F.lit(_BLANK)) != "")
    return full.select("doc_id", "th", "at", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _judge(rows: list[tuple], key: int, across: bool, edits: int, out: dict) -> None:
    """Finds the near lines among rows (h1, h2, place, text, block) of one key and one block, or across two.

    A pair is told where its shorter line is indexed (of equal lengths, that with the lesser hash),
    under the first of its segments that the other line holds.
    """
    texts = [r[3] for r in rows]
    lengths, blocks = np.array([len(t) for t in texts]), np.array([r[4] for r in rows])
    ranks = np.argsort(np.argsort(np.array([(r[0], r[1]) for r in rows], dtype="i8,i8"), kind="stable"))
    parity = _parities(texts)
    for i, x in enumerate(texts):
        n = len(x)
        if n <= edits:
            continue
        parts = segments(n, edits)
        own = [k for k, (p, m) in enumerate(parts) if np.uint64(xxh64_intdigest(x[p : p + m].encode(), n * 16 + k)).astype(np.int64) == key]
        if not own:
            continue
        can = (lengths >= n) & (lengths <= n + edits) & ((lengths > n) | (ranks > ranks[i])) & (np.bitwise_count(parity ^ parity[i]) <= 2 * edits)
        if across:
            can &= blocks != blocks[i]
        for j in np.flatnonzero(can).tolist():
            y = texts[j]
            if x == y:
                continue
            held = {k - 16 * n for k, s, e in probes(len(y), edits) if k // 16 == n and y[s:e] == x[parts[k % 16][0] : sum(parts[k % 16])]}
            if held and min(held) in own and within(x, y, edits):
                later = i if rows[i][2] > rows[j][2] else j
                for k in (i, j):
                    links, late = out.get(rows[k][:2], (0, False))
                    out[rows[k][:2]] = links + 1, late or k == later


def linked_lines(docs: DataFrame, edits: int = 2, min_chars: int = 16, hot_rows: int = HOT_ROWS) -> DataFrame:
    """h1, h2 (hashes of a line), links (how many other lines are within edits edits of it) and late
    (whether one of them occurs earlier), for each line that has any.

    A line of length n is cut into edits + 1 segments, of which one is untouched in any line so
    near. Segments are keyed by their text, n and their number; lines that are as long, or longer by
    up to edits, look up the substrings that can match. Keys that a single line has are dropped as
    rows of the sorted keys go by. A hot key's rows skip that shuffle: they are seen as such where
    they are made. The lines of each key that is left are dealt to blocks by number and bytes, and
    each pair of blocks is a group of its own that a task compares: first the parities of the
    characters' counts, of which an edit flips two at most, then the edit distance. So a task holds
    two blocks at a time, and rows are counts of a line's links, not pairs.

    Null and empty texts, and lines of fewer than min_chars code points, have no links. Equal lines are
    one, however often they occur; the first place of each is the least (doc_id, hash of the text,
    line). An empty table gives no rows.
    """
    by_key = Window.partitionBy("key", "salt").orderBy("line")
    several = (F.lag("line").over(by_key) != F.col("line")) | (F.lead("line").over(by_key) != F.col("line"))
    rows = _seed_rows(docs, edits, min_chars, hot_rows).withColumn("several", several).filter("several OR salt > 0")
    members = stored(rows.select("key", "line").distinct(), "line-keys")
    wanted = stored(members.select(F.col("line").alias("h1")).distinct(), "line-hashes")
    if wanted.count() <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    found = _lines(docs).join(wanted, "h1", "left_semi").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "at")).alias("place"), F.any_value("line").alias("text"))
    held = stored(members.join(found.withColumnRenamed("h1", "line"), "line"), "key-lines")
    sizes = stored(held.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("text")) / BLOCK_BYTES)).alias("blocks")), "key-sizes")
    dealt = held.join(sizes, "key").withColumn("block", F.pmod("h2", "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    pairs = dealt.select("key", "line", "h2", "place.*", "text", "block", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def compare(batches):
        forget_encoders()
        batch_of = arrow_table(_JUDGED)
        last, group, out = None, [], {}
        for b in batches:
            for key, lo, hi, h1, h2, doc, th, at, text, block in zip(*(b.column(c).to_pylist() for c in ("key", "lo", "hi", "line", "h2", "doc_id", "th", "at", "text", "block"))):
                if (key, lo, hi) != last:
                    if len(group) > 1:
                        _judge(group, last[0], last[1] != last[2], edits, out)
                    last, group = (key, lo, hi), []
                group.append((h1, h2, (doc, th, at), text, block))
            if len(out) > 20_000:
                yield batch_of([*map(list, zip(*((*k, *v) for k, v in out.items())))])
                out = {}
        if len(group) > 1:
            _judge(group, last[0], last[1] != last[2], edits, out)
        if out:
            yield batch_of([*map(list, zip(*((*k, *v) for k, v in out.items())))])

    told = pairs.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(compare, fields(_JUDGED))
    return told.groupBy("h1", "h2").agg(F.sum("links").alias("links"), F.max("late").alias("late"))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def dedup_lines(docs: DataFrame, edits: int = 2, min_chars: int = 16, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Removes each line that an earlier line equals, or is near to by at most edits edits.

    Lines are what lies between line feeds. Earlier is a smaller doc_id or, in one document, a line
    above. A line is removed if it is not the first of its text, or if its text has a link to
    another text that occurs earlier. Blank lines (spaces, tabs, carriage returns) always stay;
    links are sought between lines of at least min_chars code points. Returns doc_id, th (a hash of
    the text), n_lines, n_removed, n_links (links of the texts that first occur in the document), kept_sha256 and kept
    (the lines left, joined by line feeds).

    Equal lines are aggregated by two 64-bit hashes before they meet, so a line that all documents
    hold costs a row for each task. Null or empty texts have no line to remove. A row with a null
    doc_id is compared with nothing and stays whole. Rows with the same doc_id are ordered by a hash
    of their texts; copies of a row have the same result. An empty table gives no rows. Other
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", _text_hash())
    real = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    place = F.struct("doc_id", "th", "at")
    firsts = stored(_lines(real).groupBy("h1", "h2").agg(F.min(place).alias("first")), "line-firsts")
    linked = stored(linked_lines(real, edits, min_chars, hot_rows), "linked-lines")
    judged = firsts.join(linked, ["h1", "h2"], "left").select("first.*", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("late", F.lit(False)).alias("late"))
    per_doc = judged.groupBy("doc_id", "th").agg(F.collect_list(F.when(~F.col("late"), F.col("at"))).alias("keep"), F.sum("links").alias("links"))

    def apply(batches):
        forget_encoders()
        batch_of = arrow_table(_DONE)
        for b in slices(batches):
            out = []
            for doc, th, text, keep, n_links in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), texts_of(b.column("text")), b.column("keep").to_pylist(), b.column("links").to_pylist()):
                lines = text.split(b"\n")
                if doc is None:
                    left = lines
                else:
                    own = set(keep or ())
                    left = [x for i, x in enumerate(lines) if i in own or not x.strip(_BLANK.encode())]
                kept = b"\n".join(left)
                out.append((doc, th, len(lines), len(lines) - len(left), n_links or 0, hashlib.sha256(kept).hexdigest(), kept))
            if out:
                yield batch_of([list(c) for c in zip(*out)])

    return rows.join(per_doc, ["doc_id", "th"], "left").select("doc_id", "th", "text", "keep", "links").mapInArrow(apply, fields(_DONE))


def without_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with the lines removed from their texts, the other columns unchanged; n_chars,
    if there is one, is counted anew.

    Null texts stay null, and a document of which no line is left stays with an empty text. Ties and
    repeated rows are as in dedup_lines: rows of one doc_id are ordered by a hash of their texts, and
    copies of a row all become the same. An empty table gives no rows. Further columns may have any
    names.
    """
    doc, th, kept = (free_name(docs, n) for n in ("doc", "th", "kept"))
    done = dedup_lines(docs, **options).filter("n_removed > 0").select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.decode("kept", "UTF-8").alias(kept)).dropDuplicates([doc, th])
    out = docs.join(done, (docs["doc_id"].cast("long") == done[doc]) & (_text_hash() == done[th]), "left")
    text = F.coalesce(kept, "text")
    return out.select(*(text.alias(c) if c == "text" else F.when(F.col(kept).isNull(), F.col(c)).otherwise(F.char_length(kept)).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes))
