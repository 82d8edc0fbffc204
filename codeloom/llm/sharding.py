"""Shards of near-equal byte size that hold equal texts together, from prefix sums."""

from __future__ import annotations

import heapq
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_sums, stored, utf8

#: Groups of equal texts that are larger than this share of a shard are dealt one by one.
LARGE = 1 / 100


def _deal(groups: list[tuple[int, int]], shards: int, share: float) -> tuple[list[tuple[int, int | None]], list[float]]:
    """(digest, shard) of groups (digest, bytes), the largest first to the emptiest shard; no shard for
    those that fit in none. Also returns the room left in each shard."""
    loads = [(0, s) for s in range(shards)]
    out: list[tuple[int, int | None]] = []
    for digest, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        load, s = loads[0]
        fits = load + size <= share
        out.append((digest, s if fits else None))
        if fits:
            heapq.heapreplace(loads, (load + size, s))
    room = dict((s, share - load) for load, s in loads)
    return out, [room[s] for s in range(shards)]


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Cuts the documents into shards of near-equal size; equal texts are in one shard.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard, and slot, the gapless
    position in the shard. Documents are ordered by a digest of their text and then doc_id, so that
    equal texts are neighbours, and that order is cut at equal targets: prefix sums come from totals
    of range partitions, so no task sees more than one partition and the texts are not shuffled. A
    group of equal texts goes where its middle byte lies, which leaves a shard off its share by less
    than a group. So that this is little, groups of more than LARGE of a shard, at most
    shards / LARGE of them, are dealt beforehand and the targets leave room for them. A group that
    fits in no shard, as one larger than a shard's share, is cut like single documents.

    A null text counts as empty. Rows with a null doc_id come first in their group. Rows with the same
    doc_id and text are interchangeable. An empty table gives no rows; other columns are ignored.
    """
    spark, columns = docs.sparkSession, ["doc_id", "size", "text_crc32"]
    rows = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(utf8("text")).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    rows = stored(rows, "shard-sizes")
    share = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    sizes = rows.groupBy("digest").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > share * LARGE)
    dealt, room = _deal([(r.digest, r.bytes) for r in sizes.collect()], shards, share)  # at most shards / LARGE rows
    large = F.broadcast(spark.createDataFrame(dealt, "digest long, large_shard int").withColumn("large", F.lit(True)))
    tagged = rows.join(large, "digest", "left")
    whole = tagged.filter("large_shard IS NOT NULL").select(*columns, "digest", F.col("large_shard").alias("shard"))
    rest = tagged.filter("large_shard IS NULL").select(*columns, "digest", F.coalesce("large", F.lit(False)).alias("large"))
    placed, _ = running_sums(rest, ["digest", "doc_id", "size", "text_crc32"], ["size"], "shard-rows")
    placed = stored(placed.withColumn("middle", 2 * F.col("size_before") + F.col("size")), "shard-places")
    targets = [2 * sum(room[: k + 1]) for k in range(shards - 1)]
    # only a group of equal texts that a target falls into, at most one for each, needs its own middle;
    # of all others each row has the same targets below it
    begin, end = 2 * F.col("size_before"), 2 * (F.col("size_before") + F.col("size"))
    hit = reduce(or_, ((begin <= t) & (end > t) for t in targets), F.lit(False))
    split = F.broadcast(placed.filter(~F.col("large") & hit).select("digest").distinct())
    middles = placed.filter("NOT large").join(split, "digest", "left_semi").groupBy("digest").agg((2 * F.min("size_before") + F.sum("size")).alias("of_group"))
    judged = placed.join(F.broadcast(middles), "digest", "left")  # fewer than shards rows
    middle = F.when(F.col("large"), F.col("middle")).otherwise(F.coalesce("of_group", "middle"))
    shard = sum(((middle >= t).cast("int") for t in targets), F.lit(0)).alias("shard")
    cut_rows = whole.unionByName(judged.select(*columns, "digest", shard))
    order = ["shard", "digest", "doc_id", "size", "text_crc32"]
    final, _ = running_sums(cut_rows, order, ["size"], "shards")
    first = final.groupBy("shard").agg(F.min("row_before").alias("first"))
    return final.join(F.broadcast(first), "shard").select(*columns, "shard", (F.col("row_before") - F.col("first")).alias("slot"))  # a row for each shard
