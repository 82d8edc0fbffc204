"""Bursts of change notifications, and upkeep of a stored table by batches of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from codeloom.operators.findings import upserted
from codeloom.operators.upkeep import merge_buckets


def quiet_bursts(events: DataFrame, key: str, quiet: str = "1 hour", at: str = "ts", what: str = "event_id") -> DataFrame:
    """Bursts of a key's events with no pause of quiet between them: burst start and end, number and
    the last event. Works on batches and, with a watermark on at, on streams."""
    gap = F.session_window(at, quiet)
    return events.groupBy(key, gap.alias("w")).agg(F.count("*").alias("events"), F.max_by(what, F.struct(at, what)).alias("last_event"), F.min(at).alias("first_ts"), F.max(at).alias("last_ts")).select(key, "first_ts", "last_ts", "events", "last_event")


def keep_current(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str) -> DataStreamWriter:
    """A query that keeps the newest row of each key of a stream under path, a new version for each
    batch; read it with current(). The two newest versions stay."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")
        old = current(spark, path, number - 1)
        (newest if old is None else upserted(old, newest, key)).write.mode("overwrite").parquet(f"{path}/v={number}")
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={number - 2}")  # a reader may still be at the one before
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def current(spark, path: str, version: int):
    """The table as of a batch; None before the first."""
    return None if version < 0 else spark.read.parquet(f"{path}/v={version}")


def keep_buckets(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str, buckets: int = 256) -> DataStreamWriter:
    """A query that keeps the newest row of each key of a stream in a table in buckets: each batch
    rewrites only the buckets that its rows fall into."""
    return stream.writeStream.foreachBatch(lambda rows, _: merge_buckets(rows, path, key, order, buckets)).option("checkpointLocation", checkpoint)


def watched(spark, folder: str, pruned: list[str], glob: str = "*.json", schema: str = "path string, change string, at timestamp") -> DataFrame:
    """A stream of change notifications from the files that appear in a folder, without those below
    folders that are never watched: a path with such a folder anywhere in it does not enter."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).json(folder)
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return rows.filter(F.col("path").isNotNull() & ~F.arrays_overlap(folders, F.array(*map(F.lit, pruned)))) if pruned else rows
