"""Findings, snapshots and stored tables: listing, counting, replacing, comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)


def with_dismissals(findings: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Adds dismissed, whether the finding's type and fingerprint are dismissed in its project."""
    known = dismissals.select("project", "finding_type", "fingerprint").distinct().withColumn("dismissed", F.lit(True))
    return findings.join(known, ["project", "finding_type", "fingerprint"], "left").na.fill(False, ["dismissed"])


def replaced(stored: DataFrame, new: DataFrame, types: list[str]) -> DataFrame:
    """The stored findings without those of the types, and the new ones of these types."""
    return stored.filter(~F.col("finding_type").isin(types)).unionByName(new.filter(F.col("finding_type").isin(types)))


def upserted(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new by key, and stored rows whose key new does not have."""
    return new.unionByName(stored.join(new.select(*key), key, "left_anti").select(*new.columns))


def latest_per(rows: DataFrame, group: str, order: list[Column], keep: int) -> DataFrame:
    """The first keep rows of each group in the order; Spark keeps only so many of each task's rows
    before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= keep).drop("_n")


def fingerprint_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: added, removed (distinct fingerprints) and persisted (rows of after, copies counted)."""
    b = before.select("fingerprint").distinct().withColumn("b", F.lit(1))
    a = after.groupBy("fingerprint").agg(F.count("*").alias("n"))
    both = a.join(b, "fingerprint", "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.coalesce(F.sum(F.when(F.col("b").isNotNull(), F.col("n"))), F.lit(0)).alias("persisted"))


def keyed_delta(rows: DataFrame, key: list[str], before: Column, after: Column) -> DataFrame:
    """direction (added, removed) and key of the keys that only one side has, in one aggregation; a
    row is on a side if before or after says so."""
    sides = rows.groupBy(*key).agg(F.max(before.cast("int")).alias("b"), F.max(after.cast("int")).alias("a")).filter("a <> b")
    return sides.select(*key, F.when(F.col("a") == 1, "added").otherwise("removed").alias("direction"))


def retained(delta: DataFrame, order: list[str], keep: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The first keep rows in the order, added before removed, and a row of total, kept and truncated."""
    rank = F.when(F.col("direction") == "added", 0).otherwise(1)
    counts = delta.agg(F.count("*").alias("total"))
    return delta.orderBy(*order, rank).limit(keep), counts.select("total", F.least("total", F.lit(keep)).alias("kept"), (F.col("total") > keep).alias("truncated"))


def page(rows: DataFrame, order: list[str], offset: int, size: int = 100) -> DataFrame:
    """size rows from offset on in a total order; size is 1 to 500."""
    if offset < 0 or not 1 <= size <= 500:
        raise ValueError("offset must not be negative, and size from 1 to 500")
    return rows.orderBy(*order).offset(offset).limit(size)


def in_scope(findings: DataFrame, scope: str, value: str | None = None) -> DataFrame:
    """Findings of a report's scope: the project, a part of a related file's path, a related symbol, or
    a type of finding. related: the node addresses that a finding is about."""
    if scope == "project":
        return findings
    if scope == "file":
        return findings.filter(F.exists("related", lambda n: n.startswith("file:") & n.contains(value)))
    if scope == "symbol":
        return findings.filter(F.array_contains("related", value))
    if scope == "type":
        return findings.filter(F.col("finding_type") == value)
    raise ValueError(f"no scope {scope}")
