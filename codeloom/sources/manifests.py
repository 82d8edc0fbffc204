"""Facts of manifests, configs, git trees and statuses as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.tables import stored

# Languages by extension; other files are plaintext.
LANGUAGES = {
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".json": "json", ".jsonc": "json", ".json5": "json",
    ".html": "html", ".htm": "html", ".vue": "html", ".svelte": "html", ".astro": "html",
    ".css": "css", ".scss": "scss", ".less": "less", ".md": "markdown", ".mdx": "markdown",
    ".py": "python", ".go": "go", ".rs": "rust", ".yml": "yaml", ".yaml": "yaml", ".xml": "xml", ".svg": "xml",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".ps1": "powershell", ".sql": "sql", ".toml": "ini", ".ini": "ini", ".env": "ini",
    ".graphql": "graphql", ".gql": "graphql", ".dockerfile": "dockerfile",
}
# Bounds of a tree that is reviewed.
MAX_TREE_ENTRIES, MAX_TREE_BYTES = 100_000, 2 * 1024 * 1024 * 1024

_MAP = "map<string,string>"


def language_of(path: Column) -> Column:
    """The language of a file by its name."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    by_extension = F.coalesce(F.try_element_at(known, F.regexp_extract(name, r"(\.[^.]*)$", 1)), F.lit("plaintext"))
    special = F.when((name == "dockerfile") | name.startswith("dockerfile."), "dockerfile").when(name.isin("makefile", "gnumakefile"), "makefile")
    return special.when(name.isin(".gitignore", ".gitattributes", ".dockerignore"), "plaintext").otherwise(by_extension)


def _text(column: str, name: str) -> Column:
    """A field of a manifest if it is a JSON string."""
    value = F.try_variant_get(F.try_parse_json(column), f"$.{name}", "string")
    return F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(column), f"$.{name}", "variant")) == "STRING", value)


def package_names(manifests: DataFrame, text: str = "text") -> DataFrame:
    """The distinct names that package manifests give their own packages."""
    return manifests.select(_text(text, "name").alias("package")).filter("package IS NOT NULL").distinct()


def public_api(manifests: DataFrame, key: str, text: str = "text", keep: int = 50) -> DataFrame:
    """key and api, a manifest's public entries: exports, by key or as one string, main and types; the
    first keep distinct ones."""
    exports = F.coalesce(F.map_keys(F.from_json(F.get_json_object(text, "$.exports"), _MAP)), F.array_compact(F.array(_text(text, "exports"))))
    listed = F.concat(exports, F.array_compact(F.array(_text(text, "main"), _text(text, "types"))))
    return manifests.select(key, F.slice(F.array_distinct(listed), 1, keep).alias("api"))


def entry_paths(manifests: DataFrame, key: str, text: str = "text", depth: int = 5) -> DataFrame:
    """key and path of the entries that manifests name: main, module, browser, types, exports down to
    depth levels of conditions, and bin; without a leading ./"""
    top = manifests.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.get_json_object(text, f"$.{n}").alias("j"), _text(text, n).alias("s")) for n in ("main", "module", "browser", "types", "exports", "bin")))).alias("f")).select(key, "f.*").filter("j IS NOT NULL")
    found = top.filter("s IS NOT NULL").select(key, F.col("s").alias("path"))
    deep = top.filter("s IS NULL AND n IN ('exports', 'bin')").select(key, "j", F.when(F.col("n") == "bin", 1).otherwise(depth - 1).alias("left"))
    for _ in range(depth - 1):
        inner = deep.filter("left > 0").select(key, F.explode(F.from_json("j", _MAP)).alias("k", "j"), (F.col("left") - 1).alias("left"))
        # values of a map of strings: a JSON object stays one, a string comes bare
        found = found.unionByName(inner.filter("j NOT LIKE '{%' AND j NOT LIKE '[%'").select(key, F.col("j").alias("path")))
        deep = inner.filter("j LIKE '{%'")
    return found.select(key, F.regexp_replace(F.regexp_replace("path", r"^\./", ""), r"\\", "/").alias("path")).distinct()


def licences(specifiers: DataFrame, installed: DataFrame, package: Column, keep: int = 400) -> DataFrame:
    """package, version and license of the first keep distinct packages of specifiers; null where no
    manifest is installed or a field is no string. installed: package, text."""
    names = specifiers.select(package.alias("package")).distinct().orderBy("package").limit(keep)
    facts = installed.select("package", _text("text", "version").alias("version"), _text("text", "license").alias("license")).groupBy("package").agg(F.min("version").alias("version"), F.min("license").alias("license"))
    return names.join(facts, "package", "left")


def language_roots(files: DataFrame) -> DataFrame:
    """kind (go, rust or python), name and root of the module, crate and packages that manifests at the
    root name. files: path, text. A Python package is local if its __init__.py is there, below src
    rather than beside it."""
    first = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    go = files.filter("path = 'go.mod'").select(F.lit("go").alias("kind"), first(r"(?m)^module\s+(\S+)").alias("name"), F.lit("").alias("root"))
    rust = files.filter("path = 'Cargo.toml'").select(F.lit("rust").alias("kind"), first(r'(?m)^name\s*=\s*"([^"]+)"').alias("name"), F.lit("").alias("root"))
    names = files.filter("path IN ('pyproject.toml', 'setup.cfg')").select(F.explode(F.regexp_extract_all("text", F.lit(r"""(?m)^name\s*=\s*["']([^"']+)["']"""), F.lit(1))).alias("name"))
    places = names.select(F.replace("name", F.lit("-"), F.lit("_")).alias("name")).distinct().select("name", F.posexplode(F.array(F.concat(F.lit("src/"), "name"), F.col("name"))).alias("rank", "root"))
    inits = files.select(F.regexp_extract("path", r"^(.*)/__init__\.py$", 1).alias("root")).filter("root <> ''")
    python = places.join(inits, "root").groupBy("name").agg(F.min_by("root", "rank").alias("root")).select(F.lit("python").alias("kind"), "name", "root")
    return go.unionByName(rust).filter("name IS NOT NULL").unionByName(python)


def tree_entries(records: DataFrame, column: str = "value") -> DataFrame:
    """mode, type, object_id, size and path of "git ls-tree -r -l -z" records; a record that is none is
    an error."""
    row = r"^([0-7]{6}) (blob|commit) ([0-9a-f]{40}|[0-9a-f]{64}) +([0-9]+|-)\t([\s\S]+)$"
    part = lambda k: F.regexp_extract(column, row, k)
    size = part(4).try_cast("long")
    good = F.col(column).rlike(row) & ((part(2) == "blob") == size.isNotNull())
    checked = records.filter(F.when(good, True).otherwise(F.raise_error(F.lit("not a record of a tree")).cast("boolean")))
    return checked.select(part(1).alias("mode"), part(2).alias("type"), part(3).alias("object_id"), size.alias("size"), part(5).alias("path"))


def preflight(entries: DataFrame, max_entries: int = MAX_TREE_ENTRIES, max_bytes: int = MAX_TREE_BYTES) -> DataFrame:
    """One row: entries, bytes of plain files, links, submodules, collisions (paths that are equal but for
    case), and fits, whether the tree can be written out."""
    plain = F.col("mode").isin("100644", "100755")
    sums = entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.when(plain, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("mode") == "120000").alias("links"), F.count_if(F.col("mode") == "160000").alias("submodules"))
    doubles = entries.groupBy(F.lower("path").alias("p")).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("collisions"))
    both = sums.crossJoin(doubles)  # single rows
    return both.withColumn("fits", (F.col("entries") <= max_entries) & (F.col("bytes") <= max_bytes) & (F.col("collisions") == 0))


def status_entries(output: DataFrame, column: str = "value") -> DataFrame:
    """change, staged, unstaged, path and old_path of "git status --porcelain=v2 -z" output, one row for
    each record; a rename's or copy's record is followed by its old path.

    output: one row for each status, column its bytes as text, records ended by NUL. Index and work
    tree are merged: a path that either side adds is added, one that either deletes is deleted.
    """
    tokens = F.split(F.regexp_replace(column, "\0$", ""), "\0")
    rows = output.select(F.posexplode(tokens).alias("at", "token"), tokens.alias("tokens"))
    kind = F.substring("token", 1, 2)
    moved = F.get("tokens", F.col("at") - 1).startswith("2 ") & ~F.col("token").rlike("^[12u?!] ")
    named = rows.filter(~F.coalesce(moved, F.lit(False)) & kind.isin("1 ", "2 ", "u ", "? ")).withColumn("fields", F.split("token", " "))
    skip = F.when(kind == "1 ", 8).when(kind == "2 ", 9).when(kind == "u ", 10).otherwise(1)
    path = F.array_join(F.slice("fields", skip + 1, F.size("fields")), " ")
    xy = F.when(kind == "? ", "??").otherwise(F.get("fields", F.lit(1)))
    x, y = F.substring(xy, 1, 1), F.substring(xy, 2, 1)
    change = F.when(kind == "? ", "untracked").when(kind == "u ", "conflicted").when((x == "R") | (y == "R"), "renamed").when((x == "C") | (y == "C"), "copied")
    change = change.when((x == "D") | (y == "D"), "deleted").when((x == "A") | (y == "A"), "added").otherwise("modified")
    old = F.when(kind == "2 ", F.get("tokens", F.col("at") + 1))
    return named.select(change.alias("change"), (~x.isin(".", "?")).alias("staged"), (y != ".").alias("unstaged"), path.alias("path"), old.alias("old_path"))


def renames(log: DataFrame, record: str = "value", keep: int = 200) -> DataFrame:
    """commit, at (the place in the log), old_path and path of the first keep renames of
    "git log -M --diff-filter=R --format=%x1e%H --name-status" records, numbered by n."""
    lines = F.split(F.col(record), "\r?\n")
    rows = log.select("n", lines[0].alias("commit"), F.posexplode(lines).alias("line_no", "line"))
    row = r"^R\d+\t(.+)\t(.+)$"
    return rows.filter(F.col("line").rlike(row)).select("commit", F.struct("n", "line_no").alias("at"), F.regexp_extract("line", row, 1).alias("old_path"), F.regexp_extract("line", row, 2).alias("path")).orderBy("at").limit(keep)


def css_references(sheets: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind (import or url), target and n of a style sheet's imports and of its url() outside them;
    comments say nothing."""
    plain = F.regexp_replace(text, r"/\*[\s\S]*?\*/", " ")
    rule = r"""(?i)@import\s+(?:url\(\s*)?["']?([^"')\s;]+)"""
    imports = F.transform(F.regexp_extract_all(plain, F.lit(rule), F.lit(1)), lambda t: F.struct(F.lit("import").alias("kind"), t.alias("target")))
    rest = F.regexp_replace(plain, r"(?i)@import[^;]*;?", " ")
    urls = F.transform(F.regexp_extract_all(rest, F.lit(r"""(?i)url\(\s*["']?([^"')\s]+)"""), F.lit(1)), lambda t: F.struct(F.lit("url").alias("kind"), t.alias("target")))
    return sheets.select(key, F.explode(F.concat(imports, urls)).alias("r")).groupBy(key, "r.kind", "r.target").agg(F.count("*").alias("n"))


def line_marks(findings: DataFrame) -> DataFrame:
    """path, line, kind (conflict or broken) and titles of the lines that findings which are not dismissed
    lie on; a conflict wins. findings: path, finding_type, title, dismissed, start_line, end_line."""
    conflict = F.col("finding_type") == "merge-conflict"
    marks = conflict | F.col("finding_type").isin("syntax-error", "type-error", "unresolved-import", "todo-comment", "complexity-hotspot", "duplicate-code")
    last = F.when(conflict, F.coalesce("end_line", "start_line")).otherwise(F.col("start_line"))
    lines = findings.filter(marks & ~F.col("dismissed") & (F.col("start_line") > 0) & (last >= F.col("start_line"))).select("path", "title", conflict.alias("c"), F.explode(F.sequence("start_line", last)).alias("line"))
    return lines.groupBy("path", "line").agg(F.when(F.bool_or("c"), "conflict").otherwise("broken").alias("kind"), F.array_sort(F.collect_set("title")).alias("titles"))


def exclusion_log(paths: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """path and kind: every reason for which a path is left out, of which one path may have several."""
    found = F.array_compact(F.array(*(F.when(c, kind) for kind, c in reasons.items())))
    return paths.select("path", F.explode(found).alias("kind"))


def nearest_configs(configs: DataFrame, max_depth: int = 3, keep: int = 12) -> DataFrame:
    """config_path, folder and text of the configs used: one for each folder (tsconfig before jsconfig),
    down to max_depth folders, the first keep by path. configs: path, text."""
    name, folder = F.regexp_extract("path", "([^/]*)$", 1), F.regexp_replace("path", "/?[^/]*$", "")
    known = configs.withColumn("folder", folder).withColumn("rank", F.when(name == "tsconfig.json", 0).when(name == "jsconfig.json", 1))
    deep = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    one = known.filter(F.col("rank").isNotNull() & (deep <= max_depth)).groupBy("folder").agg(F.min_by(F.struct("path", "text"), "rank").alias("c"))
    return one.select(F.col("c.path").alias("config_path"), "folder", "c.text").orderBy("config_path").limit(keep)


def tolerant_json(text: str) -> Column:
    """The text without comments and commas before a closing bracket; what stands in strings stays."""
    return F.regexp_replace(F.regexp_replace(text, r"""("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/""", "$1"), r"""("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])""", "$1")


def json_verdicts(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and verdict of texts that should be JSON: valid, tolerant (once comments and trailing commas are
    out), empty (nothing but white space, or null) or broken."""
    # the parser stops after one value; that nothing follows is told by putting the text inside of others
    parses = lambda c: F.try_parse_json(F.concat(F.lit("["), c, F.lit("\n]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("\n}"))).isNotNull()
    t = F.col(text)
    verdict = F.when(t.isNull() | t.rlike(r"^\s*$"), "empty").when(parses(t), "valid").when(parses(tolerant_json(text)), "tolerant").otherwise("broken")
    return files.select(key, verdict.alias("verdict"))


def config_facts(configs: DataFrame) -> DataFrame:
    """config_path, folder, base_url and aliases of nearest_configs(), for import resolution. Comments
    and trailing commas are taken out first; a config that is no JSON has no facts."""
    bare = tolerant_json("text")
    options = F.from_json(bare, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")["compilerOptions"]
    base = lambda p: F.array_join(F.filter(F.split(F.concat_ws("/", "folder", p), "/"), lambda x: (x != "") & (x != ".")), "/")
    root = F.coalesce(options["baseUrl"], F.lit("."))
    aliases = F.transform(F.map_entries(options["paths"]), lambda e: F.struct(e["key"].alias("pattern"), F.transform(e["value"], lambda t: base(F.concat_ws("/", root, t))).alias("targets")))
    return configs.select("config_path", "folder", F.when(options["baseUrl"].isNotNull(), base(root)).alias("base_url"), aliases.alias("aliases"))


def inherited_facts(configs: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """config_path, folder, base_url, aliases, chain (the configs read, the config itself first) and
    problem (null, or cycle or missing) of configs with what they inherit by "extends".

    configs: path and text of every config that may be used or inherited from; used: config_path of
    those asked for, all if not given. A config takes base_url and aliases each from the nearest config
    of its chain that has it; aliases are relative to the base, or, without one, to the config that has
    them. Of a list of parents a later one comes before an earlier one. Parents are sought beside the
    config, as named or with .json; packages are not followed and count as missing. The chain grows by
    one config a round, for all configs at once, and ends where a config would come again.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    bare = tolerant_json("text")
    options = F.from_json(bare, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")["compilerOptions"]
    parents = F.coalesce(F.from_json(bare, "extends array<string>")["extends"], F.array_compact(F.array(F.get_json_object(bare, "$.extends"))))
    plain = lambda *parts: F.aggregate(F.filter(F.split(F.concat_ws("/", *parts), "/"), lambda x: (x != "") & (x != ".")), F.array().cast("array<string>"), lambda a, x: F.when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(x))))
    named = F.transform(parents, lambda e: F.array_join(plain("folder", F.when(e.startswith("."), e).otherwise(F.concat(F.lit("node_modules/"), e))), "/"))
    rows = configs.withColumn("folder", folder).withColumn("parents", named)
    known = stored(rows.select("path", "folder", options["baseUrl"].alias("base"), options["paths"].alias("paths"), "parents"), "configs")
    names = known.select(F.explode(F.array("path", F.regexp_replace("path", r"\.json$", ""))).alias("name"), "path").groupBy("name").agg(F.min_by("path", F.struct(F.col("path") != F.col("name"), "path")).alias("parent"))
    links = stored(known.select("path", F.posexplode("parents").alias("k", "name")).join(names, "name", "left").select("path", (-F.col("k")).alias("k"), "name", "parent"), "config-links")
    start = known.select(F.col("path").alias("config_path"), F.col("path").alias("at"), F.array("path").alias("chain"), F.array().cast("array<int>").alias("rank"), F.lit(None).cast("string").alias("problem"))
    if used is not None:
        start = start.join(used.select("config_path").distinct(), "config_path", "left_semi")
    frontier = stored(start, "config-chains")
    chains = frontier
    while True:
        step = frontier.filter("problem IS NULL").join(links.withColumnRenamed("path", "at"), "at")
        again = F.array_contains("chain", F.col("parent"))
        problem = F.when(F.col("parent").isNull(), "missing").when(again, "cycle")
        nxt = step.select("config_path", F.col("parent").alias("at"), F.when(problem.isNull(), F.concat("chain", F.array("parent"))).otherwise(F.col("chain")).alias("chain"), F.concat("rank", F.array("k")).alias("rank"), problem.alias("problem"))
        frontier = stored(nxt, "config-chains")
        if frontier.isEmpty():
            break
        chains = chains.unionByName(frontier)
    facts = chains.filter("problem IS NULL").join(known.select(F.col("path").alias("at"), "folder", "base", "paths"), "at")
    root = F.array_join(plain("folder", "base"), "/")
    order = F.col("rank")  # of two chains the one that is the other's beginning is nearer
    best = facts.groupBy("config_path").agg(
        F.min_by(F.when(F.col("base").isNotNull(), root), F.when(F.col("base").isNotNull(), order)).alias("base_url"),
        F.min_by(F.when(F.col("paths").isNotNull(), F.struct("folder", "paths")), F.when(F.col("paths").isNotNull(), order)).alias("p"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "at"))), lambda x: x["at"]).alias("chain"),
    )
    problems = chains.groupBy("config_path").agg(F.min("problem").alias("problem"))
    base = F.coalesce("base_url", "p.folder")
    aliases = F.transform(F.map_entries("p.paths"), lambda e: F.struct(e["key"].alias("pattern"), F.transform(e["value"], lambda t: F.array_join(plain(base, t), "/")).alias("targets")))
    out = best.select("config_path", F.regexp_replace("config_path", "/?[^/]*$", "").alias("folder"), "base_url", aliases.alias("aliases"), "chain")
    return out.join(problems, "config_path")
