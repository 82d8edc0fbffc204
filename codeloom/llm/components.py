"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_table, fields, stored

_LINK = "u long, v long"
#: Links that one task unites at most, on average; some 100 MB.
TASK_LINKS = 500_000


def _forest(batches):
    """Union-find over the links of one task; a link from each node to its least one."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            a, b_ = root(u), root(v)
            if a != b_:
                parent[max(a, b_)] = min(a, b_)
    out = [(x, root(x)) for x in parent if root(x) != x]
    if out:
        yield arrow_table(_LINK)([list(c) for c in zip(*out)])


def components(links: DataFrame) -> DataFrame:
    """node and component (its least node) of every node that a link (columns u, v) touches.

    Each task unites up to TASK_LINKS links to a forest. If one task holds them all, that is the
    answer. Else all roots move to their least neighbour, links are drawn between what has been
    united, and what is left is united again, in ever fewer tasks. Neither end of a link may be null;
    repeated links and links of a node to itself change nothing, and no links give no rows.
    """
    edges = stored(links.select("u", "v"), "links")
    roots = None
    while True:
        tasks = -(-edges.count() // TASK_LINKS)
        edges = stored(edges.coalesce(max(1, tasks)).mapInArrow(_forest, fields(_LINK)), "forest")
        if roots is None:
            roots = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("component", F.col("node"))
        if tasks <= 1:  # links of a single task lead to roots
            return roots.join(edges, roots["component"] == edges["u"], "left").select("node", F.coalesce("v", "component").alias("component"))
        both = edges.union(edges.select("v", "u"))
        up = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("x"), F.least("u", "v").alias("y"))
        up = stored(up.alias("a").join(up.alias("b"), F.col("a.y") == F.col("b.x")).select("a.x", F.col("b.y").alias("y")), "parents")
        roots = stored(roots.join(up, roots["component"] == up["x"], "left").select("node", F.coalesce("y", "component").alias("component")), "roots")
        moved = edges.join(up.select(F.col("x").alias("u"), F.col("y").alias("u2")), "u").join(up.select(F.col("x").alias("v"), F.col("y").alias("v2")), "v")
        edges = stored(moved.select(F.col("u2").alias("u"), F.col("v2").alias("v")).filter("u <> v").distinct(), "links")
