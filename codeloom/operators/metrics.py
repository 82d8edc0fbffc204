"""Coupling, outliers, change-impact scores, churn and co-change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.ids import folder_of, share

# Points for each and at most, by factor of the score.
DIRECT, TRANSITIVE, FROM_ENTRY, IN_CYCLE, UNRESOLVED, UNTESTED = (3, 30), (1, 30), 15, 15, (1, 5), 5


def folder_coupling(files: DataFrame, edges: DataFrame, is_abstract) -> DataFrame:
    """Edges into and out of each folder, instability and abstractness.

    files: id, path; edges: src, dst. Folders are the first two directories. Every edge between two
    folders counts, parallel ones too.
    """
    home = files.select("id", folder_of(F.col("path")).alias("folder"), is_abstract.alias("abstract"))
    sizes = home.groupBy("folder").agg(F.count("*").alias("files"), F.count_if("abstract").alias("abstract_files"))
    a, b = (home.select(F.col("id").alias(c), F.col("folder").alias(f"{c}_folder")) for c in ("src", "dst"))
    across = edges.join(a, "src").join(b, "dst").filter("src_folder <> dst_folder").groupBy("src_folder", "dst_folder").agg(F.count("*").alias("n"))
    out = across.groupBy(F.col("src_folder").alias("folder")).agg(F.sum("n").alias("efferent"))
    into = across.groupBy(F.col("dst_folder").alias("folder")).agg(F.sum("n").alias("afferent"))
    all_ = sizes.join(out, "folder", "full").join(into, "folder", "full").na.fill(0, ["files", "abstract_files", "efferent", "afferent"])
    return all_.select("folder", "files", "afferent", "efferent", F.round(share(F.col("efferent"), F.col("efferent") + F.col("afferent")), 6).alias("instability"), F.round(share(F.col("abstract_files"), F.col("files")), 6).alias("abstractness"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_in and fan_out in edges, parallel ones counted, and dependents, distinct sources."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast("long").alias("by")).union(edges.select("dst", F.lit(1), F.lit(0), "src"))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.count_distinct("by").alias("dependents"))


def outliers(files: DataFrame, edges: DataFrame, symbols: DataFrame, top: int = 25) -> DataFrame:
    """The files with the largest size + 80 x symbols + 40 x fan-in, ties by path."""
    fan = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    own = symbols.groupBy("id").agg(F.count("*").alias("symbols"))
    rows = files.join(own, "id", "left").join(fan, "id", "left").na.fill(0, ["symbols", "fan_in"])
    return rows.select("path", "size_bytes", "symbols", "fan_in", (F.col("size_bytes") + 80 * F.col("symbols") + 40 * F.col("fan_in")).alias("weight")).orderBy(F.desc("weight"), "path").limit(top)


def impact_scores(nodes: DataFrame, direct: DataFrame, reached: DataFrame, cyclic: DataFrame, from_entry: DataFrame, unresolved: DataFrame, tested: DataFrame) -> DataFrame:
    """The score of each node with the points of its six factors and its mid-rank percentile.

    nodes: node. direct: node, direct (distinct dependents). reached: node, reached (all dependents).
    cyclic, from_entry, tested: node. unresolved: node, unresolved. All meet by shuffles: a number for each
    node takes little room in a shuffle's files, by which Spark would broadcast it, and much in memory.
    """
    flag = lambda df, name: df.select("node").distinct().withColumn(name, F.lit(True)).hint("merge")
    direct, reached, unresolved = (df.hint("merge") for df in (direct, reached, unresolved))
    rows = nodes.select("node").join(direct, "node", "left").join(reached, "node", "left").join(unresolved, "node", "left").na.fill(0, ["direct", "reached", "unresolved"])
    rows = rows.join(flag(cyclic, "cyc"), "node", "left").join(flag(from_entry, "ent"), "node", "left").join(flag(tested, "tst"), "node", "left").na.fill(False, ["cyc", "ent", "tst"])
    cap = lambda col, rule: F.least(col * rule[0], F.lit(rule[1]))
    rows = rows.select(
        "node",
        cap(F.col("direct"), DIRECT).alias("direct_points"),
        cap(F.greatest(F.col("reached") - F.col("direct"), F.lit(0)), TRANSITIVE).alias("transitive_points"),
        F.when(F.col("ent"), FROM_ENTRY).otherwise(0).alias("entry_points"),
        F.when(F.col("cyc"), IN_CYCLE).otherwise(0).alias("cycle_points"),
        cap(F.col("unresolved"), UNRESOLVED).alias("unresolved_points"),
        F.when(F.col("tst"), 0).otherwise(UNTESTED).alias("untested_points"),
    )
    return rows.withColumn("score", F.least(F.lit(100), sum((F.col(c) for c in rows.columns[1:]), F.lit(0))).cast("int"))


def with_percentiles(scores: DataFrame, score: str = "score") -> DataFrame:
    """Adds percentile, the mid-rank: all that score less and half of those that score the same, in
    a hundred, rounded. The window is over the distinct scores, not the rows."""
    by = scores.groupBy(score).agg(F.count("*").alias("_n"))
    upto = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_n").over(Window.partitionBy())
    rank = by.select(score, F.round((F.sum("_n").over(upto) - F.col("_n") + F.col("_n") / 2.0) / total * 100).cast("int").alias("percentile"))
    return scores.join(F.broadcast(rank), score)  # scores are integers of 0 to 100


def churn(touches: DataFrame, days: int = 90, top: int = 200, days_of: DataFrame | None = None) -> DataFrame:
    """Commits, additions and deletions of files in the last days before the latest commit; the most
    touched ones. days_of, a smaller table of the commits' days, spares a pass over all touches."""
    latest = (touches if days_of is None else days_of).agg(F.max("day")).first()[0]  # a literal prunes the scan
    recent = touches.filter(F.col("day") >= F.lit(latest) - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy("file").agg(F.count_distinct("commit").alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")).orderBy(F.desc("commits"), "file").limit(top)


def co_change(touches: DataFrame, file: int, last_commits: int = 50, top: int = 30) -> DataFrame:
    """Files that changed in the same commits as a file, over its last commits."""
    own = touches.filter(F.col("file") == file).select("commit", "day").distinct().orderBy(F.desc("day"), F.desc("commit")).limit(last_commits).select("commit")
    others = touches.filter(F.col("file") != file).select("commit", "file").distinct().join(F.broadcast(own), "commit", "left_semi")  # at most last_commits rows
    return others.groupBy("file").agg(F.count("*").alias("shared_commits")).orderBy(F.desc("shared_commits"), "file").limit(top)


def capability_counts(files: DataFrame, group: str) -> DataFrame:
    """Files by what can be done with them, ten counts in one pass. files: status, git_ignored,
    user_excluded."""
    by = {"eligible": "eligible", "text_only": "text-only", "binary": "binary", "excluded": "excluded", "oversize": "oversize", "unreadable": "unreadable", "symlink": "symlink"}
    counts = [F.count_if(F.col("status") == status).alias(name) for name, status in by.items()]
    return files.groupBy(group).agg(F.count("*").alias("total"), *counts, F.count_if("git_ignored").alias("git_ignored"), F.count_if("user_excluded").alias("user_excluded"))


def examples(rows: DataFrame, group: str, value: str, keep: int = 3) -> DataFrame:
    """group, n (its rows), examples (the keep least values, in order) and more (how many are left).

    The least values are picked before rows are shuffled, so no task gets a group as a whole."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(value))
    least = rows.select(group, value).withColumn("_n", nth).filter(F.col("_n") <= keep).groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("examples"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.join(least, group, "left").select(group, "n", "examples", F.greatest(F.col("n") - keep, F.lit(0)).alias("more"))
