"""Neighbours in an order, by range partitions, and points in ranges, by bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.tables import stored


def with_previous(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds name, the value of the row before this one in its group, or null.

    rows should be narrow: they are range-partitioned by group and order and written. The last row
    of each partition, one row each, is handed to the next, so no task holds a whole group.
    """
    keys = [*group, *order]
    placed = stored(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    last = placed.groupBy("_part").agg(F.max_by(F.struct(*group, F.col(value).alias("_value")), F.struct(*keys)).alias("_last"))
    before = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_before"))  # a row for each partition
    inside = Window.partitionBy("_part").orderBy(*keys)
    own = F.lag(F.struct(*group, F.col(value).alias("_value"))).over(inside)
    there = placed.join(F.broadcast(before), "_part").withColumn("_before", F.coalesce(own, "_before"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col("_before")[g])
    return there.withColumn(name, F.when(same, F.col("_before._value"))).drop("_part", "_before")


def in_ranges(points: DataFrame, ranges: DataFrame, by: str, at: str, first: str, last: str) -> DataFrame:
    """The points with each range of the same by that holds them, first <= at <= last; points in none go
    on without one. by is one name on both sides, others must differ; ranges end no earlier than they begin.

    A range lies in one or two bins of the least power of two that is no shorter, so it is one or two
    rows, however long; a point is a row for each such length that there is. They meet by an equal
    join on by, length and bin.
    """
    level = F.ceil(F.log2(F.col(last) - F.col(first) + 1)).cast("int")
    sized = ranges.filter(F.col(last) >= F.col(first)).withColumn("_level", level)
    levels = [r[0] for r in sized.select("_level").distinct().collect()]  # at most 64
    bin_of = lambda c, n: F.floor(F.col(c) / F.pow(F.lit(2.0), n)).cast("long")
    binned = sized.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(first, F.col("_level")), bin_of(last, F.col("_level"))))))
    own = stored(points.withColumn("_point", F.monotonically_increasing_id()), "points")
    spread = own.select(by, at, "_point", F.explode(F.array(*map(F.lit, sorted(levels)))).alias("_level")).withColumn("_bin", bin_of(at, F.col("_level"))) if levels else own.select(by, at, "_point", F.lit(0).alias("_level"), F.lit(0).cast("long").alias("_bin"))
    met = spread.join(binned, [by, "_level", "_bin"]).filter((F.col(at) >= F.col(first)) & (F.col(at) <= F.col(last)))
    added = [c for c in ranges.columns if c != by]
    return own.join(met.select("_point", *added), "_point", "left").drop("_point")
