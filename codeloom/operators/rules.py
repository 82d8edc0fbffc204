"""Rules between folders, unused exports, path policies and owners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import ids, patterns
from codeloom.functions.patterns import glob_regex, is_framework


def violations(edges: DataFrame, files: DataFrame, rules: list[dict]) -> DataFrame:
    """rule, severity, source, target, line of resolved edges that a rule forbids.

    A rule has name, severity, source and target globs and exceptions, globs of sources or targets
    that it lets pass. Rules are data of a few rows; they are tested on the distinct paths, and only
    then do edges join, so no path is matched once per edge. Of parallel edges the first line counts.
    """
    paths = files.select("id", "path")

    def matching(side: str) -> DataFrame:
        hits = [F.when(F.col("path").rlike(glob_regex(r[side])) & ~reduce(lambda a, b: a | b, (F.col("path").rlike(glob_regex(x)) for x in r.get("exceptions", ())), F.lit(False)), F.lit(k)) for k, r in enumerate(rules)]
        return paths.select("id", "path", F.explode(F.array_compact(F.array(*hits))).alias("rule_no"))

    s = matching("source").select(F.col("id").alias("src"), F.col("path").alias("source"), "rule_no")
    t = matching("target").select(F.col("id").alias("dst"), F.col("path").alias("target"), F.col("rule_no").alias("rule_t"))
    real = edges.filter(~F.col("unresolved") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.min("line").alias("line"))
    hit = real.join(s, "src").join(t, "dst").filter("rule_no = rule_t")
    name, severity = (F.element_at(F.array(*(F.lit(r[c]) for r in rules)), F.col("rule_no") + 1) for c in ("name", "severity"))
    return hit.select(name.alias("rule"), severity.alias("severity"), "source", "target", "line")


def layer_matrix(found: DataFrame, rules: list[dict]) -> DataFrame:
    """source_layer, target_layer (first segments of the globs) and how many violations lie there."""
    layers = sorted({r[side].split("/")[0] for r in rules for side in ("source", "target")})
    spark = found.sparkSession
    pairs = spark.createDataFrame([(a, b) for a in layers for b in layers], "source_layer string, target_layer string")
    by_rule = spark.createDataFrame([(r["name"], r["source"].split("/")[0], r["target"].split("/")[0]) for r in rules], "rule string, source_layer string, target_layer string")
    counts = found.join(F.broadcast(by_rule), "rule").groupBy("source_layer", "target_layer").agg(F.count("*").alias("violations"))  # a row for each rule
    return pairs.join(counts, ["source_layer", "target_layer"], "left").na.fill(0, ["violations"])


def unused_exports(symbols: DataFrame, used: DataFrame, excluded: list[str], package_entries: DataFrame | None = None, barrels: DataFrame | None = None, renamed: DataFrame | None = None) -> DataFrame:
    """path, name and caveats of exported symbols that nothing refers to.

    symbols: id, path, name, is_entry, is_re_export, is_default, is_component. used: id of symbols
    with a resolved reference. Entry points, also those of packages (path), re-exports, paths that
    frameworks load and what is excluded, globs or path#name, are left out. Caveats: barrel and renamed
    for paths of these tables, default and component by the symbol.
    """
    skip = reduce(lambda a, b: a | b, (F.col("path").rlike(glob_regex(g)) for g in excluded if "#" not in g), F.lit(False))
    skip = skip | F.concat("path", F.lit("#"), "name").isin([g for g in excluded if "#" in g])
    for paths, flag in ((barrels, "_barrel"), (renamed, "_renamed")):
        known = symbols.select("path").limit(0) if paths is None else paths.select("path").distinct()
        symbols = symbols.join(known.withColumn(flag, F.lit(True)), "path", "left")
    if package_entries is not None:
        symbols = symbols.join(package_entries.select("path").distinct(), "path", "left_anti")
    left = symbols.filter(~(F.col("is_entry") | F.col("is_re_export") | is_framework(F.col("path")) | skip)).join(used.select("id").distinct(), "id", "left_anti")
    caveats = F.array_compact(F.array(F.when(F.col("_barrel"), "barrel"), F.when(F.col("is_default"), "default"), F.when(F.col("is_component"), "component"), F.when(F.col("_renamed"), "renamed")))
    return left.select("path", "name", F.array_join(caveats, ",").alias("caveats"))


def policy(path: Column, excluded: Column, ignored: Column, tests_off: Column, otherwise: Column) -> Column:
    """A file's status: a user's exclusion goes before ignore files, these before disabled tests."""
    return F.when(excluded, "excluded-user").when(ignored, "excluded-ignore").when(tests_off, "excluded-test").otherwise(otherwise)


def owners(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds owner: that of the last rule (glob, owner) whose glob the path ends with, case aside."""
    out = F.lit(None).cast("string")
    for glob, owner in rules:
        pattern = "(?i)" + glob_regex(("" if glob.startswith("/") else "**/") + glob.strip("/"))
        out = F.when(F.col("path").rlike(pattern), owner).otherwise(out)
    return files.withColumn("owner", out)


def excluded_by_user(path: Column, globs: list[str]) -> Column:
    """Whether a glob matches the path or any folder above it."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda n: F.array_join(F.slice(F.split(path, "/"), F.lit(1), n), "/"))
    return F.exists(prefixes, lambda p: patterns.any_of(p, [patterns.glob_regex(g) for g in globs]))


def layered_ignores(files: DataFrame, ignores: DataFrame, max_files: int = 10_000) -> DataFrame:
    """path and ignored of every file under ignore files at several depths: of all rules that match a
    path the last one of the nearest file decides. ignores: folder ("" for the root) and text, at most
    max_files, counted as they come; a rule meets only paths below its folder, by a join on folders."""
    texts = ignores.select("folder", "text").limit(max_files + 1).collect()
    if len(texts) > max_files:
        raise ValueError(f"more than {max_files} ignore files")
    found = [(r.folder, len(r.folder.split("/")) if r.folder else 0, n, negated, regex) for r in texts for n, negated, regex in patterns.ignore_rules(r.text, r.folder)]
    table = files.sparkSession.createDataFrame(found, "folder string, depth int, line int, negated boolean, regex string")
    folders = F.concat(F.array(F.lit("")), ids.ancestors(F.col("path")))
    met = files.select("path", F.explode(folders).alias("folder")).join(F.broadcast(table), "folder").filter("path RLIKE regex")
    last = met.groupBy("path").agg(F.max_by(~F.col("negated"), F.struct("depth", "line")).alias("hit"))
    return files.select("path").join(last, "path", "left").select("path", F.coalesce("hit", F.lit(False)).alias("ignored"))


def entry_points(files: DataFrame, named: DataFrame, edges: DataFrame) -> DataFrame:
    """id and inferred of the entries: the files whose path is named (path), or, where no named path
    exists, those that no edge leads to."""
    known = files.join(named.select("path").distinct(), "path", "left_semi").select("id", F.lit(False).alias("inferred"))
    bare = files.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("inferred"))
    none = F.broadcast(known.agg(F.count("*").alias("_named")))  # one row
    return known.unionByName(bare.crossJoin(none).filter("_named = 0").drop("_named"))
