"""Import specifiers to files: every file tells the names it can be imported by, and one join meets them."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.tables import stored

# Extensions that are appended to a specifier, in the order in which they are tried.
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".d.ts", ".vue", ".svelte", ".astro", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".py", ".go", ".rs")
# Extensions of files that are sources.
SOURCE_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".astro", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".py", ".go", ".rs")
# What an output's extension may stand for, in order.
OUTPUT_TO_SOURCE = {".js": (".ts", ".tsx", ".js", ".jsx"), ".mjs": (".mts", ".mjs"), ".cjs": (".cts", ".cjs"), ".jsx": (".tsx", ".jsx")}
# Extensions of imports that are no sources.
ASSETS = (".styl", ".json", ".json5", ".yaml", ".yml", ".toml", ".svg", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".avif", ".ico", ".bmp", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".md", ".mdx", ".txt", ".csv", ".xml", ".wasm", ".glsl", ".frag", ".vert", ".graphql", ".gql")

# Languages of importers for which a file has further names.
LANGUAGES = (".py", ".rs", ".go")

_TEXTS = "array<string>"

#: Folders whose configs are sent to every task, counted first; beyond it imports meet them by a shuffle.
SENT_FOLDERS = 10_000


def folder_of(path: Column) -> Column:
    """What is before the last slash; empty without one."""
    return F.left(path, F.greatest(F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1, F.lit(0)))


def _walked(path: Column) -> Column:
    """A path without . and .. segments; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast(_TEXTS).alias("path"), F.lit(False).alias("out"))
    step = F.aggregate(
        parts,
        start,
        lambda a, p: F.when(p != "..", F.struct(F.concat(a["path"], F.array(p)).alias("path"), a["out"].alias("out"))).otherwise(
            F.struct(F.slice(a["path"], 1, F.greatest(F.size(a["path"]) - 1, F.lit(0))).alias("path"), (a["out"] | (F.size(a["path"]) == 0)).alias("out"))
        ),
    )
    return F.when(~step["out"], F.array_join(step["path"], "/"))


def lead_of(specifier: Column) -> Column:
    """The dots and slashes that a specifier begins with."""
    return F.left(specifier, F.length(specifier) - F.length(F.ltrim(specifier, F.lit("./"))))


def joined(folder: Column, specifier: Column, lead: Column | None = None) -> Column:
    """folder/specifier without . and .. segments; null if it leaves the root. lead: the specifier's lead_of.

    Where such segments only lead the specifier, the folder loses one of its own for each ..; other
    paths are walked through."""
    lead = lead_of(specifier) if lead is None else lead
    has = lambda text, *parts: functools.reduce(operator.or_, (text.contains(p) for p in parts))
    even = lambda text: ~has(F.concat(F.lit("/"), text, F.lit("/")), "//", "/./", "/../")  # noqa: E731  no segment is empty, . or ..
    rest = F.substring(specifier, F.length(lead) + 1, F.length(specifier))
    up = F.length(lead) - F.length(F.replace(lead, F.lit(".."), F.lit(".")))
    deep = F.when(folder == "", 0).otherwise(F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit(""))) + 1)
    left = F.call_function("substring_index", folder, F.lit("/"), deep - up)
    short = F.when(up < deep, F.concat(left, F.lit("/"), rest)).when(up == deep, rest)
    leads = (lead == "") | (lead.endswith("/") & ~lead.startswith("/") & ~has(lead, "//", "..."))
    return F.when(leads & ((folder == "") | even(folder)) & even(rest), short).otherwise(_walked(F.concat_ws("/", folder, specifier)))


def _extension(path: Column) -> Column:
    """From the last dot on; empty without a dot in the last segment."""
    last = F.substring_index(F.concat(F.lit("/"), path), ".", -1)
    return F.when(last.contains("/"), "").otherwise(F.concat(F.lit("."), last))


def _lower(text: Column) -> Column:
    """F.lower, which is slow, of what is not in small letters."""
    return F.when(text.rlike(r"[A-Z]|[^\x00-\x7f]"), F.lower(text)).otherwise(text)


def names_of(files: DataFrame) -> DataFrame:
    """name, rank, lang and path: under which names a file is found, the best rank first.

    A file is found by its path, by a path with the extension of its output, without its extension,
    and by its folder if it is an index; for importers in one language (lang) also by the folder of a
    package or module file, and of any file of the package.
    """
    row = lambda name, rank, lang=None: F.struct(name.alias("name"), F.lit(rank).cast("int").alias("rank"), F.lit(lang).cast("string").alias("lang"))
    place = lambda extensions: F.array_position(F.array(*map(F.lit, extensions)), F.col("ext"))
    told = files.select("path", F.substring_index("path", "/", -1).alias("base"), folder_of(F.col("path")).alias("folder"), _extension(F.col("path")).alias("ext"))
    told = told.withColumn("stem", F.expr("left(path, length(path) - length(ext))")).withColumn("place", place(EXTENSIONS))
    path, base, folder, stem = (F.col(c) for c in ("path", "base", "folder", "stem"))
    names = [row(path, 0)]
    for output, sources in OUTPUT_TO_SOURCE.items():
        names.append(F.when(place(sources) > 0, row(F.concat(stem, F.lit(output)), 9 + place(sources))))
    names.append(F.when(F.col("place") > 0, row(stem, 99 + F.col("place"))))
    for word, rank, lang in (("index", 200, None), ("__init__", 300, ".py"), ("mod", 300, ".rs")):
        names.append(F.when((F.col("place") > 0) & (base == F.concat(F.lit(word), F.col("ext"))), row(folder, rank - 1 + F.col("place"), lang)))
    for k, e in enumerate(EXTENSIONS):
        if e.count(".") == 2:
            names.append(F.when(path.endswith(e), row(F.expr(f"left(path, length(path) - {len(e)})"), 100 + k)))
            names += [F.when(base == f"{word}{e}", row(folder, rank + k, lang)) for word, rank, lang in (("index", 200, None), ("__init__", 300, ".py"), ("mod", 300, ".rs"))]
    own = base == F.concat(F.substring_index("folder", "/", -1), F.lit(".go"))
    names.append(F.when(_lower(F.col("ext")) == ".go", F.when(own, row(folder, 400, ".go")).otherwise(row(folder, 401, ".go"))))
    return told.select("path", F.explode(F.array(*names)).alias("n")).filter("n IS NOT NULL").select("path", "n.*")


def best_names(files: DataFrame) -> DataFrame:
    """A row for each name with the best file, as rank and path: any for all importers, and a column for
    each of LANGUAGES of what only its importers find."""
    best = F.struct("rank", "path")
    return names_of(files).groupBy("name").agg(F.min(F.when(F.col("lang").isNull(), best)).alias("any"), *(F.min(F.when(F.col("lang") == e, best)).alias(e[1:]) for e in LANGUAGES))


def _found(lang: Column) -> Column:
    """The path that an importer in a language finds by a row of best_names."""
    return F.least("any", F.coalesce(*(F.when(lang == e, F.col(e[1:])) for e in LANGUAGES)))["path"]


def nearest_config(imports: DataFrame, configs: DataFrame) -> DataFrame:
    """Adds base_url and aliases of the config in the deepest folder above from_path, of several there
    the first by config_path. configs: config_path, folder ("" for the root), base_url, aliases.
    Null without any. A folder's config is found once for all its files."""
    rows = imports.withColumn("_home", folder_of(F.col("from_path")))
    above = rows.select("_home").distinct().select("_home", F.explode(F.expr("transform(sequence(0, size(split(_home, '/'))), k -> array_join(slice(split(_home, '/'), 1, k), '/'))")).alias("folder"))
    best = F.min_by(F.struct("base_url", "aliases"), F.struct(-F.length("folder"), F.col("config_path"))).alias("c")
    found = stored(above.join(configs, "folder").groupBy("_home").agg(best), "nearest-config")
    found = F.broadcast(found) if found.count() <= SENT_FOLDERS else found.hint("merge")
    return rows.join(found, "_home", "left").select(*imports.columns, "c.base_url", "c.aliases")


def _after_star(text: Column) -> Column:
    return F.regexp_extract(text, r"^[^*]*\*([\s\S]*)$", 1)


def prepared_aliases(aliases: Column) -> Column:
    """Aliases (pattern, targets) taken apart, in the order in which they win: those without a star, then
    those with the longest part before it, the first of equals."""
    part = lambda t, star: F.struct(star.alias("star"), F.when(star, F.substring_index(t, "*", 1)).otherwise(t).alias("before"), F.when(star, _after_star(t)).alias("after"))
    star = lambda a: a["pattern"].contains("*")
    prefix = lambda a: F.substring_index(a["pattern"], "*", 1)
    used = F.filter(aliases, lambda a: a["pattern"].isNotNull() & (star(a) | a["targets"].isNotNull()))
    each = F.transform(used, lambda a, k: F.struct(star(a).alias("star"), F.when(star(a), -F.length(prefix(a))).otherwise(0).alias("n"), k.alias("k"), prefix(a).alias("prefix"), _after_star(a["pattern"]).alias("suffix"), F.transform(a["targets"], lambda t: part(t, star(a) & t.contains("*"))).alias("targets")))
    return F.array_sort(each)


def matching_alias(specifier: Column, aliases: Column) -> Column:
    """The first of prepared aliases that a specifier matches."""
    wild = lambda a: specifier.startswith(a["prefix"]) & specifier.endswith(a["suffix"]) & (F.length(specifier) >= F.length(a["prefix"]) + F.length(a["suffix"]))
    return F.get(F.filter(aliases, lambda a: F.when(a["star"], wild(a)).otherwise(specifier == a["prefix"])), F.lit(0))


def alias_targets(specifier: Column, alias: Column) -> Column:
    """Paths that a specifier stands for by the alias that it matches; null without one."""
    held = F.substring(specifier, F.length(alias["prefix"]) + 1, F.length(specifier) - F.length(alias["prefix"]) - F.length(alias["suffix"]))
    return F.transform(alias["targets"], lambda t: F.when(t["star"], F.concat(t["before"], held, t["after"])).otherwise(t["before"]))


def resolved(imports: DataFrame, files: DataFrame, packages: list[str] = (), configs: DataFrame | None = None, workspaces: list[str] = (), builtins: list[str] = ()) -> DataFrame:
    """Adds target, via_alias and reason to imports (from_path, specifier).

    A relative specifier, or one that names a source file, is sought from its folder, one with a
    leading slash from the root, others through the aliases and the base of the nearest config. Of a
    place's files that with the best rank of names_of wins. A target is never guessed: what is not
    found keeps a null target and a reason: file-not-found, external-package, alias-not-configured
    or non-source-asset. packages, workspaces and builtins are names of known packages.

    Where to look is worked out once for an import and stored. Imports with one place meet the names of
    files in one join; those without any meet none, and only those whose alias has several targets are
    made rows for each of them.
    """
    if configs is not None:
        imports = stored(imports, "imports-given")  # read for their folders first
    rows = imports.withColumn("_s", F.trim("specifier"))
    if configs is not None:
        rows = nearest_config(rows, configs.withColumn("aliases", prepared_aliases(F.col("aliases"))))
    s, aliased = F.col("_s"), F.lit(False)
    rows = rows.withColumn("_ext", _lower(_extension(F.substring_index(s, "?", 1)))).withColumn("_lead", lead_of(s))
    rows = rows.withColumn("_asset", F.col("_ext").isin(*ASSETS)).withColumn("_relative", s.startswith("./") | s.startswith("../") | s.isin(".", "..") | (~s.startswith("/") & F.col("_ext").isin(*SOURCE_EXTENSIONS)))
    asset, relative = F.col("_asset"), F.col("_relative")
    rows = rows.withColumn("_plain", F.coalesce((s != "") & ~asset & ~relative & ~s.startswith("/"), F.lit(False)))
    base = F.lit(None).cast("string")
    if configs is not None:
        rows = rows.withColumn("_alias", F.when(F.col("_plain"), matching_alias(s, F.col("aliases"))))
        rows = rows.withColumn("_targets", alias_targets(s, F.col("_alias")))
        aliased, base = F.coalesce(F.size("_targets") > 0, F.lit(False)), F.col("base_url")
        rows = rows.withColumn("_names", F.when(aliased, F.array_compact(F.transform("_targets", lambda t: joined(F.lit(""), t)))))
    rows = rows.withColumn("_at", F.when(relative, F.coalesce(folder_of(F.col("from_path")), F.lit(""))).when(s.startswith("/"), F.lit("")).otherwise(base))
    one = F.when((s == "") | asset, F.lit(None)).when(~aliased & F.col("_at").isNotNull(), joined(F.col("_at"), s, F.col("_lead")))
    if configs is not None:
        one = F.when(aliased, F.when(F.size("_names") == 1, F.get("_names", F.lit(0)))).otherwise(one)
    package = F.regexp_extract(s, "^(@[^/]+/[^/]+|[^/]+)", 1)
    known = s.startswith("node:") | package.isin(list(builtins)) | package.isin(list(packages)) | package.isin(list(workspaces))
    aliaslike = s.startswith("~") | s.startswith("#") | (s.startswith("@") & (F.size(F.split(s, "/")) >= 3))
    reason = F.when(asset, "non-source-asset").when((s == "") | relative | s.startswith("/") | aliased, "file-not-found").when(aliaslike & ~known, "alias-not-configured").otherwise("external-package")
    lang = _lower(_extension(F.col("from_path")))
    several = [F.when(F.size("_names") > 1, F.col("_names")).alias("_several")] if configs is not None else []
    held = stored(rows.select(*imports.columns, lang.alias("_lang"), one.alias("_one"), "_plain", reason.alias("_reason"), *several), "imports")
    names = best_names(files).hint("merge")
    out = lambda df: df.select(*imports.columns, "target", (F.col("target").isNotNull() & F.col("_plain")).alias("via_alias"), F.when(F.col("target").isNull(), F.col("_reason")).alias("reason"))
    single = held.filter("_one IS NOT NULL").join(names, F.col("_one") == F.col("name"), "left").withColumn("target", _found(F.col("_lang")))
    rest = held.filter("_one IS NULL").withColumn("target", F.lit(None).cast("string"))
    if configs is None:
        return out(single).unionByName(out(rest))
    wanted = held.filter("_several IS NOT NULL").select("from_path", "specifier", "_lang", F.posexplode("_several").alias("_k", "name"))
    hits = wanted.join(names, "name").withColumn("path", _found(F.col("_lang"))).filter("path IS NOT NULL").groupBy("from_path", "specifier").agg(F.min_by("path", "_k").alias("target"))
    many = held.filter("_several IS NOT NULL").join(hits.hint("merge"), ["from_path", "specifier"], "left")
    return out(single).unionByName(out(many)).unionByName(out(rest.filter("_several IS NULL")))
