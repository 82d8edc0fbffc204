"""Files, edges, commits and findings as projections of the business tables.

Parts are files, an order's consecutive line items are an edge between their parts, orders are
commits, events are findings, and documents are texts. All rows of the tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.tables import read


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, name, size_bytes, is_entry, kind, price of each part as a file; met by shuffles, as paths
    are many times as large in memory as the columns in the files that they are made from."""
    part = read(spark, sf_dir, "part").hint("merge")
    suffix = F.when(F.col("p_size") < 5, ".test.ts").otherwise(".ts")
    path = F.concat("p_type", F.lit("/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), suffix)
    return part.select(F.col("p_partkey").alias("id"), path.alias("path"), F.col("p_name").alias("name"), (F.col("p_partkey") * F.col("p_size")).alias("size_bytes"), (F.col("p_size") == 50).alias("is_entry"), F.col("p_type").alias("kind"), F.col("p_size").alias("weight"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, edge_type, unresolved, line, day of every pair of consecutive line items."""
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_tax", "l_quantity", "l_extendedprice", "l_shipdate")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_tax", "l_shipdate")
    kind = F.when(F.col("l_returnflag") == "A", "import").when(F.col("l_returnflag") == "N", "re-export").otherwise("dynamic-import")
    follow = item.withColumn("dst", F.lead("l_partkey").over(order)).filter("dst IS NOT NULL")
    return follow.select(F.col("l_partkey").alias("src"), "dst", kind.alias("edge_type"), (F.col("l_tax") == 0.08).alias("unresolved"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("day"), F.col("l_orderkey").alias("commit"))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct resolved pairs src, dst; an index for traversal, without loops to the same file."""
    return edges(spark, sf_dir).filter(~F.col("unresolved") & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, day, file, additions, deletions of every line item as a file's change."""
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return item.join(order, item["l_orderkey"] == order["o_orderkey"]).select(F.col("l_orderkey").alias("commit"), F.col("o_orderdate").alias("day"), F.col("l_partkey").alias("file"), F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """finding_id, found_at, finding_type, severity, title, project, fingerprint of each event."""
    from codeloom.functions.ids import fingerprint

    e = read(spark, sf_dir, "events")
    severity = F.when(F.col("value") >= 100, "high").when(F.col("value") >= 50, "medium").when(F.col("value") >= 20, "low").otherwise("info")
    title = F.concat("event_type", F.lit(" "), F.get_json_object("props", "$.k"))
    return e.select(F.col("event_id").alias("finding_id"), F.col("ts").alias("found_at"), F.col("event_type").alias("finding_type"), severity.alias("severity"), title.alias("title"), F.col("user_id").alias("project")).withColumn("fingerprint", fingerprint("finding_type", "project", "title"))
