"""Two-sided change impact: what depends on changed files, before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graph import shortest_paths


def seeds(changes: DataFrame) -> DataFrame:
    """side and node to start from. changes: node, old_node, change.

    Added, untracked and copied files start on the target side, deleted ones on the baseline,
    modified ones on both, and renamed ones under their old name on the baseline.
    """
    target = F.when(F.col("change") != "deleted", F.struct(F.lit("target").alias("side"), F.col("node").alias("node")))
    base = F.when(F.col("change").isin("deleted", "modified", "renamed"), F.struct(F.lit("baseline").alias("side"), F.coalesce("old_node", "node").alias("node")))
    return changes.select(F.explode(F.array_compact(F.array(target, base))).alias("s")).select("s.side", "s.node").distinct()


def impact(edges: DataFrame, changes: DataFrame, max_depth: int) -> DataFrame:
    """node, depth (the least of both sides), sides (baseline, target or both) and path (of the
    nearer side, the target's first) of files that depend on changed ones, up to max_depth.

    edges: side (baseline or target), src and dst; one search follows both sides at once.
    """
    back = edges.select("side", F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = shortest_paths(back, seeds(changes), max_depth, by="side")[0].filter("depth > 0")
    best = F.min(F.struct("depth", F.when(F.col("side") == "target", 0).otherwise(1).alias("r"), "path")).alias("best")
    return both.groupBy("node").agg(best, F.array_join(F.array_sort(F.collect_set("side")), "+").alias("sides")).select("node", "best.depth", "sides", "best.path")


def candidate_tests(reached: DataFrame, tests: DataFrame) -> DataFrame:
    """The reached files that are tests: a change to what they depend on is checked by them."""
    return reached.join(tests.select("node"), "node", "left_semi")


def without_test(changes: DataFrame, reached: DataFrame, tests: DataFrame) -> DataFrame:
    """Changed files from which no path of the impact leads to a test."""
    covered = candidate_tests(reached, tests).select(F.col("path")[0].alias("node")).distinct()
    return changes.select("node").distinct().join(covered, "node", "left_anti")


def evidence(reached: DataFrame) -> DataFrame:
    """The distinct edges src, dst that the impact's paths run over; src depends on dst."""
    step = F.explode(F.arrays_zip(F.slice("path", 2, 1 << 20).alias("src"), F.expr("slice(path, 1, size(path) - 1)").alias("dst"))).alias("e")
    return reached.filter(F.size("path") > 1).select(step).select("e.*").distinct()
