"""Upkeep of stored tables: owners, entries, prunes, states, dismissals, atomic replacement."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.findings import latest_per, severity_rank, with_dismissals
from codeloom.tables import stored as written


def carried(stored: DataFrame, new: DataFrame, changed: DataFrame, owner: str, scan: str, scan_id: Column) -> DataFrame:
    """The new rows, and the stored ones of owners that did not change, restamped with the scan's id.
    changed has the column owner."""
    kept = stored.join(changed.select(owner).distinct(), owner, "left_anti")
    return kept.withColumn(scan, scan_id).select(*new.columns).unionByName(new)


def owned_by(rows: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """The rows of the given owners, for all of them in one join."""
    return rows.join(owners.select(owner).distinct(), owner, "left_semi")


def with_entries(files: DataFrame, listed: DataFrame, key: str = "id") -> DataFrame:
    """is_entry of every file: true for those listed, false for all others."""
    flags = listed.select(key).distinct().withColumn("_listed", F.lit(True))
    return files.drop("is_entry").join(flags, key, "left").withColumn("is_entry", F.coalesce("_listed", F.lit(False))).drop("_listed")


def exported_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Exported symbols with their file's path, in order of path and name."""
    return symbols.filter("is_exported").join(files.select(F.col("id").alias("file_id"), "path"), "file_id").orderBy("path", "name", "symbol_id")


def json_equals(rows: DataFrame, column: str, path: str, value: str) -> DataFrame:
    """Rows whose JSON has the value at the path; what does not parse has none."""
    return rows.filter(F.get_json_object(column, path) == value)


def pruned(scans: DataFrame, children: DataFrame, group: str, order: list[Column], keep: int, scan: str) -> tuple[DataFrame, DataFrame]:
    """The newest keep scans of each group, and the children of those alone."""
    left = latest_per(scans, group, order, keep)
    return left, children.join(left.select(scan), scan, "left_semi")


def latest(scans: DataFrame, group: str, at: str, key: str, status: str | None = None) -> DataFrame:
    """Each group's newest scan by time and key, of those with the status if one is given."""
    rows = scans if status is None else scans.filter(F.col("status") == status)
    return rows.groupBy(group).agg(F.max_by(F.struct(*rows.columns), F.struct(at, key)).alias("r")).select("r.*")


def undismissed_counts(findings: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Findings that are not dismissed, by type, all types in one aggregation."""
    return with_dismissals(findings, dismissals).filter("NOT dismissed").groupBy("finding_type").agg(F.count("*").alias("findings"))


_DISMISSAL = ["project", "finding_type", "fingerprint"]


def dismissed(dismissals: DataFrame, new: DataFrame) -> DataFrame:
    """Adds dismissals; one that is there already stays as it is."""
    return dismissals.select(*_DISMISSAL).union(new.select(*_DISMISSAL)).distinct()


def undismissed(dismissals: DataFrame, undone: DataFrame) -> DataFrame:
    """Removes dismissals; one that is not there is no error."""
    return dismissals.select(*_DISMISSAL).distinct().join(undone.select(*_DISMISSAL).distinct(), _DISMISSAL, "left_anti")


def listed_findings(findings: DataFrame, dismissals: DataFrame, finding_type: str | None = None, is_dismissed: bool | None = None) -> DataFrame:
    """Findings with dismissed, of one type and state if these are given, the gravest first."""
    rows = with_dismissals(findings, dismissals)
    rows = rows if finding_type is None else rows.filter(F.col("finding_type") == finding_type)
    rows = rows if is_dismissed is None else rows.filter(F.col("dismissed") == is_dismissed)
    return rows.orderBy(severity_rank(F.col("severity")), "title", "finding_id")


def interrupted(scans: DataFrame, at: Column) -> DataFrame:
    """Scans that still run are failed ones, completed at the given time; others stay."""
    runs = F.col("status") == "running"
    return scans.withColumn("completed_at", F.when(runs, at).otherwise(F.col("completed_at"))).withColumn("status", F.when(runs, "failed").otherwise(F.col("status")))


def named_rows(rows: DataFrame, name: str = "name", enabled: bool = False) -> DataFrame:
    """A small table's rows by name, of rules the enabled ones if asked."""
    return (rows.filter("enabled") if enabled else rows).orderBy(name)


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not among those deleted."""
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def readable_reviews(reviews: DataFrame, text: str, version: int, schema: str, required: list[str]) -> DataFrame:
    """Adds review, the parsed JSON, and compatible: whether it has the schema's version and all
    required fields. An incompatible row keeps a null review."""
    parsed = F.from_json(text, schema)
    whole = parsed["schemaVersion"] == version
    for field in required:
        whole = whole & parsed[field].isNotNull()
    whole = F.coalesce(whole, F.lit(False))
    return reviews.withColumn("review", F.when(whole, parsed)).withColumn("compatible", whole)


def carried_findings(stored: DataFrame, new: DataFrame, unchanged: DataFrame, types: list[str]) -> DataFrame:
    """The new findings, and of those that a text alone decides (types) the stored ones of unchanged paths."""
    old = stored.filter(F.col("finding_type").isin(types)).join(unchanged.select("path").distinct(), "path", "left_semi")
    return new.unionByName(old.select(*new.columns))


# Tables that are replaced as a whole ------------------------------------------------------------


def _folder(spark: SparkSession, path: str):
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(context._jsc.hadoopConfiguration()), context._jvm.org.apache.hadoop.fs.Path


def replace_table(rows: DataFrame, path: str) -> None:
    """Replaces the table at path as a whole: rows are written beside it, and then the folders change
    names, so a reader finds the old or the new table. What a failed write left is not seen."""
    spark = rows.sparkSession
    at, files, path_of = _folder(spark, path)
    mark = uuid.uuid4().hex
    staged, old = path_of(f"{path}.staged-{mark}"), path_of(f"{path}.old-{mark}")
    rows.write.parquet(staged.toString())
    if files.exists(at):
        files.rename(at, old)
    if not files.rename(staged, at):
        files.rename(old, at)
        raise OSError(f"{path} could not be replaced")
    files.delete(old, True)


# Tables that are published in versions ----------------------------------------------------------


def publish(rows: DataFrame, path: str, keep_seconds: int = 3600) -> str:
    """Publishes rows as the newest version of the table at path; returns the version's name.

    The rows are written to a folder of their own. Then a file whose name is the version's is made in
    path/_published, which is one step: readers take the greatest name there, so they find the former
    version or this one, and never part of one. Versions that have been followed for longer than
    keep_seconds go; a reader has that long to read what it found. What a failed write left has no
    name there and goes likewise.
    """
    spark = rows.sparkSession
    at, files, path_of = _folder(spark, path)
    names = path_of(f"{path}/_published")
    files.mkdirs(names)
    known = _published(files, names)
    number = int(known[-1][0].partition("-")[0]) + 1 if known else 0
    version = f"{number:012d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{version}")
    files.create(path_of(names, version), False).close()
    known = _published(files, names)
    now = max(t for _, t in known)
    live = {known[-1][0]} | {name for (name, _), (_, followed) in zip(known, known[1:]) if now - followed <= 1000 * keep_seconds}
    for name, _ in known:
        if name not in live:
            files.delete(path_of(names, name), False)
    for status in files.listStatus(at):
        name = status.getPath().getName()
        if name != "_published" and name not in live and now - status.getModificationTime() > 1000 * keep_seconds:
            files.delete(status.getPath(), True)
    return version


def _published(files, names) -> list[tuple[str, int]]:
    return sorted((s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(names) if not s.getPath().getName().startswith("."))


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest published version of the table at path; None before the first."""
    _, files, path_of = _folder(spark, path)
    names = path_of(f"{path}/_published")
    known = _published(files, names) if files.exists(names) else []
    return spark.read.parquet(f"{path}/{known[-1][0]}") if known else None


# Tables in buckets ------------------------------------------------------------------------------


def merge_buckets(rows: DataFrame, path: str, key: list[str], order: str, buckets: int = 256) -> int:
    """Puts rows into the table at path, which keeps the row of the greatest order for each key; returns
    how many buckets were rewritten.

    The table is partitioned by a hash of the key. Only buckets that rows fall into are read and
    replaced; all others are not touched. A batch that is put in twice changes nothing, so one that
    failed halfway is put in again.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    new = written(rows.withColumn("_bucket", bucket), "merge-batch")
    touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most buckets
    if not touched:
        return 0
    at, files, _ = _folder(spark, path)
    both = new
    if files.exists(at):
        old = spark.read.schema(new.schema).parquet(path).filter(F.col("_bucket").isin(touched))
        both = new.unionByName(old)
    newest = both.groupBy(*key, "_bucket").agg(F.max_by(F.struct(*rows.columns), F.struct(order, F.to_json(F.struct(*rows.columns)))).alias("r"))
    merged = written(newest.select("r.*", "_bucket"), "merged-buckets")
    merged.repartition("_bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("_bucket").parquet(path)
    return len(touched)
