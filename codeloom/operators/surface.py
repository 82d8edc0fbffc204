"""What a change or a file touches, and what a module exports through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graph import levels, reachable, reversed_edges, shortest_paths, stored


def _flag(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select("node").distinct().withColumn(name, F.lit(True))


def diff_impact(edges: DataFrame, changed: DataFrame, tests: DataFrame, entries: DataFrame, cyclic: DataFrame, max_depth: int = 25, keep: int = 2000) -> DataFrame:
    """node, depth, is_test, is_entry and in_cycle of the files that depend on changed ones, changed
    ones themselves left out; the first keep by depth and node. Levels beyond those are not searched."""
    found = levels(reversed_edges(edges), changed, max_depth, keep)
    rows = stored(found.filter("depth > 0").orderBy("depth", "node").limit(keep), "impact-kept")
    for nodes, name in ((tests, "is_test"), (entries, "is_entry"), (cyclic, "in_cycle")):
        rows = rows.join(_flag(nodes.hint("merge"), name), "node", "left")
    return rows.na.fill(False, ["is_test", "is_entry", "in_cycle"])


def file_detail(edges: DataFrame, file: DataFrame, tests: DataFrame, entries: DataFrame, max_depth: int = 25) -> DataFrame:
    """One row for the file (a row node): fan_in, fan_out, dependents (all, up to max_depth), tests and
    entries among them, the file itself counted as an entry if it is one, and in_cycle.

    The file is in a cycle if something that it has an edge to depends on it, which the search for
    dependents tells; only where that stopped at max_depth are the file's own dependencies followed."""
    found, cut = shortest_paths(reversed_edges(edges), file, max_depth)
    rows = found.select("node", "depth").join(_flag(tests, "t"), "node", "left").join(_flag(entries, "e"), "node", "left").na.fill(False, ["t", "e"])
    own = F.col("depth") == 0
    nexts = stored(edges.join(file.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")), "detail-next")
    others = nexts.join(file.select("node"), "node", "left_anti")
    cyclic = not others.join(found.select("node"), "node", "left_semi").isEmpty()
    if not cyclic and cut.first().truncated:
        cyclic = not reachable(edges, others).join(file.select("node"), "node", "left_semi").isEmpty()
    reach = rows.agg(F.max(F.when(own, F.col("node"))).alias("node"), F.count_if(~own).alias("dependents"), F.count_if(~own & F.col("t")).alias("tests"), F.count_if("e").alias("entries"))
    into = edges.join(file.select(F.col("node").alias("dst")), "dst", "left_semi").agg(F.count("*").alias("fan_in"))
    out = nexts.agg(F.count("*").alias("fan_out"))
    return reach.withColumn("in_cycle", F.lit(cyclic)).crossJoin(into).crossJoin(out)  # single rows


def both_directions(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """node and directions of what the roots depend on and of what depends on them, in one search."""
    ways = edges.select(F.lit("dependencies").alias("way"), "src", "dst").unionByName(edges.select(F.lit("dependents").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    start = roots.select("node").crossJoin(edges.sparkSession.createDataFrame([("dependencies",), ("dependents",)], "way string"))  # two rows
    found, _ = shortest_paths(ways, start, max_depth, by="way")
    return found.filter("depth > 0").groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("way")), "+").alias("directions"))


def export_origins(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """module, name, origin and origin_name of everything that modules export, through barrels too.

    symbols: module and name of own exports. links: module, target, name and imported of named
    re-exports, name null for a star, which forwards all names but default that the module does not
    export by itself or by name. The rows grow to a fixpoint, so cycles do no harm; a name with
    several origins is ambiguous.
    """
    named = links.filter("name IS NOT NULL").select("module", "target", "name", "imported")
    stars = stored(links.filter("name IS NULL").select("module", "target").distinct(), "stars")
    explicit = stored(symbols.select("module", "name").union(named.select("module", "name")).distinct(), "explicit-exports")
    known = new = stored(symbols.select("module", "name", F.col("module").alias("origin"), F.col("name").alias("origin_name")).distinct(), "origins")
    while not new.isEmpty():
        at = new.withColumnRenamed("module", "target")
        by_name = at.withColumnRenamed("name", "imported").join(named, ["target", "imported"]).select("module", "name", "origin", "origin_name")
        by_star = at.filter("name <> 'default'").join(stars, "target").join(explicit, ["module", "name"], "left_anti").select("module", "name", "origin", "origin_name")
        step = by_name.union(by_star).distinct()
        new = stored(step.join(known, step.columns, "left_anti"), "origins")
        known = stored(known.unionByName(new), "origins-known")
    return known


def _two_origins(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """module, name, and the origins o and p of what modules export, through barrels too; p is null where
    there is one only.

    As export_origins, but no more than two origins of a name are kept and handed on: a module that takes a
    name from one with two origins has two as well. So a row changes twice at most, and the rows are as many
    as modules and names, not as modules and all that they reach.
    """
    named = links.filter("name IS NOT NULL").select("module", "target", "name", "imported")
    stars = stored(links.filter("name IS NULL").select("module", "target").distinct(), "stars")
    explicit = stored(symbols.select("module", "name").union(named.select("module", "name")).distinct(), "explicit-exports")
    # o and p are origins, each with the name there
    two = lambda rows: rows.groupBy("module", "name").agg(F.min("o").alias("o"), F.max("o").alias("p"))
    one = lambda df: df.withColumn("p", F.when(F.col("p") != F.col("o"), F.col("p")))
    known = stored(one(two(symbols.select("module", "name", F.struct(F.col("module").alias("origin"), F.col("name").alias("origin_name")).alias("o")))).withColumn("new", F.array("o")), "origins")
    while True:
        fresh = known.filter("new IS NOT NULL")
        if fresh.isEmpty():
            break
        at = fresh.select(F.col("module").alias("target"), "name", F.explode("new").alias("o"))
        by_name = at.withColumnRenamed("name", "imported").join(named.hint("merge"), ["target", "imported"]).select("module", "name", "o")
        by_star = at.filter("name <> 'default'").join(stars, "target").join(explicit, ["module", "name"], "left_anti").select("module", "name", "o")
        told = two(by_name.unionByName(by_star)).withColumnsRenamed({"o": "a", "p": "b"})
        met = known.join(told.hint("merge"), ["module", "name"], "full")
        # of an unknown name both are new, of one with one origin the first other
        other = F.when(F.col("a") != F.col("o"), F.col("a")).when(F.col("b") != F.col("o"), F.col("b"))
        o, p = F.coalesce("o", "a"), F.when(F.col("o").isNull(), F.when(F.col("b") != F.col("a"), F.col("b"))).otherwise(F.coalesce("p", other))
        new = F.when(F.col("o").isNull(), F.array_compact(F.array("a", F.when(F.col("b") != F.col("a"), F.col("b"))))).when(F.col("p").isNull() & other.isNotNull(), F.array(other))
        known = stored(met.select("module", "name", o.alias("o"), p.alias("p"), new.alias("new")), "origins")
    return known.select("module", "name", "o", "p")


def reachable_exports(entries: DataFrame, symbols: DataFrame, links: DataFrame) -> DataFrame:
    """entry_point, exported_name, origin, origin_name and ambiguous of what entry modules (module)
    export; an ambiguous name has no origin."""
    each = _two_origins(symbols, links).join(entries.select("module").distinct(), "module", "left_semi")
    one = F.col("p").isNull()
    return each.select(F.col("module").alias("entry_point"), F.col("name").alias("exported_name"), F.when(one, F.col("o.origin")).alias("origin"), F.when(one, F.col("o.origin_name")).alias("origin_name"), (~one).alias("ambiguous"))


def unresolved_links(links: DataFrame, modules: DataFrame) -> DataFrame:
    """The re-exports whose target is null or no module."""
    return links.join(modules.select(F.col("module").alias("target")).distinct(), "target", "left_anti").select(*links.columns)
