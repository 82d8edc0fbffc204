"""Named queries over two snapshots, digests of trees, inherited configs and line ranges, and their SQL."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from codeloom.operators import digests, graph, ranges, resolve, rules, sections, surface
from codeloom.plans.queries import _RULE_HITS, EDGES, FILES, RULES, _imports, _sides, query
from codeloom.sources import imports, manifests
from codeloom.sources import projection as source
from codeloom.tables import read

_CUT = "TIMESTAMP '1998-07-01'"


def _set_sql(digest: str) -> str:
    """The digest of a set, as digests.set_digest has it."""
    lanes = ", ".join(f"sum(('0x' || substr({digest}, {8 * k + 1}, 8))::BIGINT)::VARCHAR" for k in range(8))
    return f"sha256(concat_ws(':', count(*)::VARCHAR, {lanes}))"


# Trees -------------------------------------------------------------------------------------------


def _tree_sql(name: str, files: str) -> str:
    """Folders of a tree two folders deep, as all paths of the projection are."""
    entry = lambda part, kind: f"sha256(concat({part}, chr(0), '{kind}', chr(0), digest))"
    return f"""{name}_f AS ({files}),
{name}_2 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, {_set_sql(entry("split_part(path, '/', 3)", "file"))} AS digest, count(*)::BIGINT AS files FROM {name}_f GROUP BY 1),
{name}_1 AS (SELECT split_part(folder, '/', 1) AS folder, {_set_sql(entry("split_part(folder, '/', 2)", "folder"))} AS digest, sum(files)::BIGINT AS files FROM {name}_2 GROUP BY 1),
{name} AS (SELECT * FROM {name}_2 UNION ALL SELECT * FROM {name}_1 UNION ALL SELECT '' AS folder, {_set_sql(entry("folder", "folder"))}, sum(files)::BIGINT FROM {name}_1)"""


_PLAIN = "SELECT path, sha256(concat(name, ':', size_bytes::VARCHAR)) AS digest FROM files"
_LATER = "SELECT path, sha256(concat(name, ':', (size_bytes + CASE WHEN weight = 7 THEN 1 ELSE 0 END)::VARCHAR)) AS digest FROM files WHERE id % 97 <> 0"


def _tree(files, size):
    return digests.folder_digests(files.select("path", F.sha2(F.concat(F.col("name"), F.lit(":"), size.cast("string")), 256).alias("digest")))


@query(f"WITH {FILES}, {_tree_sql('tree', _PLAIN)} SELECT * FROM tree")
def folder_digests(spark, sf):
    return _tree(source.files(spark, sf), F.col("size_bytes"))


@query(f"""WITH {FILES}, {_tree_sql('b', _PLAIN)}, {_tree_sql('a', _LATER)}
SELECT folder, CASE WHEN b.digest IS NULL THEN 'added' WHEN a.digest IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (folder) WHERE a.digest IS DISTINCT FROM b.digest""")
def changed_folders(spark, sf):
    """Folders with a file of weight 7, which grew, or one that is gone, anywhere below."""
    f = source.files(spark, sf)
    later = f.filter("id % 97 <> 0")
    return digests.changed_folders(_tree(f, F.col("size_bytes")), _tree(later, F.col("size_bytes") + F.when(F.col("weight") == 7, 1).otherwise(0)))


# Sections of a review ----------------------------------------------------------------------------


def _rule_prints() -> dict[str, str]:
    return {r["name"]: hashlib.sha256(json.dumps(r, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for r in RULES}


_PRINTS = "prints AS (SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{digest}')" for name, digest in sorted(_rule_prints().items())) + ") AS v(rule, print))"


@query(f"""WITH {FILES}, {EDGES}, {_PRINTS}, alle AS (SELECT * FROM edges),
hb AS (WITH edges AS (SELECT * FROM alle WHERE day < {_CUT}), {_RULE_HITS} SELECT * FROM hits), ha AS (WITH edges AS (SELECT * FROM alle WHERE day >= {_CUT}), {_RULE_HITS} SELECT * FROM hits),
u AS (SELECT *, 'b' AS side FROM hb UNION ALL SELECT *, 't' FROM ha), k AS (SELECT rule, severity, print, source, target, min(side) AS lo, max(side) AS hi FROM u JOIN prints USING (rule) GROUP BY ALL)
SELECT sha256(concat('{{"ruleFingerprint":"', print, '","ruleId":"', rule, '","sourcePath":"', source, '","targetPath":"', target, '"}}')) AS stable_key, CASE lo WHEN 't' THEN 'introduced' ELSE 'resolved' END AS direction,
rule AS rule_id, print AS rule_fingerprint, source AS source_path, target AS target_path, severity FROM k WHERE lo = hi""")
def violation_section(spark, sf):
    """Violations of the rules that only one of two snapshots has."""
    files, prints = source.files(spark, sf), _rule_prints()
    named = F.create_map(*(F.lit(x) for pair in prints.items() for x in pair))
    hits = [rules.violations(e, files, RULES).select(F.col("rule").alias("rule_id"), named[F.col("rule")].alias("rule_fingerprint"), F.col("source").alias("source_path"), F.col("target").alias("target_path"), "severity") for e in _sides(spark, sf)]
    return sections.section_delta(*hits, sections.violation_key(), "architecture-violations")


@query(f"""WITH RECURSIVE {FILES}, {EDGES}, l AS (SELECT DISTINCT CASE WHEN day < {_CUT} THEN 'b' ELSE 't' END AS side, src, dst FROM edges WHERE unresolved AND edge_type = 're-export'),
o(side, module, name, origin) AS (SELECT s, id, name, id FROM files, (VALUES ('b'), ('t')) AS v(s) UNION SELECT l.side, l.src, o.name, o.origin FROM o JOIN l ON l.dst = o.module AND l.side = o.side JOIN files f ON f.id = l.src WHERE f.name <> o.name),
g AS (SELECT side, module, name, count(DISTINCT origin) AS n, min(origin) AS origin FROM o WHERE module IN (SELECT id FROM files WHERE weight >= 40) GROUP BY ALL),
r AS (SELECT side, e.path AS entry_point, g.name AS exported_name, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'module' END AS symbol_kind, CASE WHEN n = 1 THEN f.path END AS origin_path FROM g JOIN files e ON e.id = module JOIN files f ON f.id = origin),
k AS (SELECT entry_point, exported_name, symbol_kind, origin_path, min(side) AS lo, max(side) AS hi FROM r GROUP BY ALL)
SELECT sha256(concat('{{"entryPoint":"', entry_point, '","exportedName":"', exported_name, '","originPath":', coalesce('"' || origin_path || '"', 'null'), ',"symbolKind":"', symbol_kind, '"}}')) AS stable_key,
CASE lo WHEN 't' THEN 'added' ELSE 'removed' END AS direction, * EXCLUDE (lo, hi) FROM k WHERE lo = hi""")
def export_section(spark, sf):
    """What entry modules export in one of two snapshots only."""
    f = source.files(spark, sf)
    entries, names = f.filter("weight >= 40").select(F.col("id").alias("module")), f.select(F.col("id").alias("module"), "name")
    at = lambda column: f.select(F.col("id").alias(column), F.col("path").alias(f"{column}_path"))
    sides = []
    for e in _sides(spark, sf):
        links = e.filter("unresolved AND edge_type = 're-export'").select(F.col("src").alias("module"), F.col("dst").alias("target"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("imported"))
        found = surface.reachable_exports(entries, names, links).join(at("entry_point"), "entry_point").join(at("origin"), "origin", "left")
        sides.append(found.select(F.col("entry_point_path").alias("entry_point"), "exported_name", F.when(F.col("ambiguous"), "ambiguous").otherwise("module").alias("symbol_kind"), "origin_path"))
    return sections.section_delta(*sides, sections.export_key(), "reachable-exports")


@query(f"""WITH RECURSIVE {FILES}, {EDGES}, d AS (SELECT DISTINCT CASE WHEN day < {_CUT} THEN 'b' ELSE 't' END AS side, src, dst FROM edges JOIN files x ON x.id = src JOIN files y ON y.id = dst
  WHERE NOT unresolved AND src <> dst AND x.kind = y.kind),
c(side, a, b) AS (SELECT * FROM d UNION SELECT c.side, c.a, d.dst FROM c JOIN d ON d.src = c.b AND d.side = c.side),
m AS (SELECT x.side, x.a AS node, least(x.a, min(x.b)) AS component FROM c x JOIN c y ON x.side = y.side AND x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.side, x.a),
s AS (SELECT side, component, count(*) AS members, min(path) AS first, {_set_sql("sha256(path)")} AS identity FROM m JOIN files ON id = node GROUP BY side, component),
k AS (SELECT identity, members, first, min(side) AS lo, max(side) AS hi FROM s GROUP BY ALL)
SELECT sha256(concat('{{"members":"', identity, '"}}')) AS stable_key, CASE lo WHEN 't' THEN 'added' ELSE 'removed' END AS direction, identity, members, first FROM k WHERE lo = hi""")
def cycle_section(spark, sf):
    """Cycles within a top folder that only one of two snapshots has, told by the set of their members."""
    f = source.files(spark, sf).select("id", "kind", "path")
    a, b = f.select(F.col("id").alias("src"), F.col("kind").alias("a")), f.select(F.col("id").alias("dst"), F.col("kind").alias("b"))
    sides = []
    for e in _sides(spark, sf):
        inner = e.filter("NOT unresolved").join(a, "src").join(b, "dst").filter("a = b").select("src", "dst")
        members = graph.strong_components(inner).join(f.select(F.col("id").alias("node"), "path"), "node")
        sides.append(digests.member_sets(members, "component", "path").select("identity", "members", "first"))
    return sections.section_delta(*sides, sections.member_key(), "cycles")


@query(f"""WITH {FILES}, {EDGES}, {_PRINTS}, p AS (SELECT {_set_sql("print")} AS rules FROM prints), e AS (SELECT DISTINCT CASE WHEN day < {_CUT} THEN 'baseline' ELSE 'target' END AS side, src, dst, edge_type FROM edges WHERE NOT unresolved),
t AS (SELECT side, {_set_sql("sha256(concat(src, '>', dst, ':', edge_type))")} AS structure FROM e GROUP BY side)
SELECT side, sha256(concat('{{"rules":"', rules, '","structure":"', structure, '","version":1}}')) AS fingerprint FROM t, p""")
def snapshot_fingerprints(spark, sf):
    """What a review of a snapshot depends on: its structure, the rules and the format's version."""
    prints = spark.createDataFrame([(p,) for p in _rule_prints().values()], "print string").agg(digests.set_digest("print").alias("rules"))
    sides = []
    for name, e in zip(("baseline", "target"), _sides(spark, sf)):
        rows = e.filter("NOT unresolved").select("src", "dst", "edge_type").distinct().select(F.sha2(F.concat(F.col("src").cast("string"), F.lit(">"), F.col("dst").cast("string"), F.lit(":"), "edge_type"), 256).alias("d"))
        sides.append(rows.agg(digests.set_digest("d").alias("structure")).withColumn("side", F.lit(name)))
    both = sides[0].unionByName(sides[1]).crossJoin(F.broadcast(prints)).withColumn("version", F.lit(1))  # a row
    return both.select("side", sections.canonical_key(structure="structure", rules="rules", version="version").alias("fingerprint"))


# Configs that inherit ----------------------------------------------------------------------------


def _configs(spark, sf):
    """A config for each kind of file, all but PROMO's with the aliases of a shared one, and two that inherit from each other."""
    kinds = source.files(spark, sf).select("kind").distinct()
    own = F.when(F.col("kind") == "PROMO", '{"extends": "../shared/base", "compilerOptions": {"paths": {"@own/*": ["./PROMO/*"]}}}').otherwise('{ // inherits\n"extends": ["../shared/far.json", "../shared/base.json"], }')
    shared = spark.createDataFrame([("shared/base.json", '{"extends": "./far.json", "compilerOptions": {"paths": {"@all/*": ["lost/*", "./*"]}}}'), ("shared/far.json", '{"compilerOptions": {"baseUrl": "..", "paths": {"@far/*": ["*"]}}}'), ("loop/a.json", '{"extends": "./b.json", "compilerOptions": {"baseUrl": "."}}'), ("loop/b.json", '{"extends": ["./a.json", "./none.json"], "compilerOptions": {"paths": {"x": ["y"]}}}')], "path string, text string")
    return kinds.select(F.concat("kind", F.lit("/tsconfig.json")).alias("path"), own.alias("text")).unionByName(shared)


@query(f"""WITH {FILES}, k AS (SELECT DISTINCT kind FROM files)
SELECT kind || '/tsconfig.json' AS config_path, '' AS base_url, CASE kind WHEN 'PROMO' THEN '@own/*=PROMO/*' ELSE '@all/*=lost/*,*' END AS aliases, CASE kind WHEN 'PROMO' THEN 'PROMO/tsconfig.json>shared/base.json>shared/far.json' ELSE concat(kind, '/tsconfig.json>shared/base.json>shared/far.json>shared/far.json') END AS chain, NULL AS problem FROM k
UNION ALL VALUES ('shared/base.json', '', '@all/*=lost/*,*', 'shared/base.json>shared/far.json', NULL), ('shared/far.json', '', '@far/*=*', 'shared/far.json', NULL), ('loop/a.json', 'loop', 'x=loop/y', 'loop/a.json>loop/b.json', 'cycle'), ('loop/b.json', 'loop', 'x=loop/y', 'loop/b.json>loop/a.json', 'cycle')""")
def inherited_settings(spark, sf):
    told = F.array_join(F.transform("aliases", lambda a: F.concat_ws("=", a["pattern"], F.array_join(a["targets"], ","))), ";")
    return manifests.inherited_facts(_configs(spark, sf)).select("config_path", "base_url", told.alias("aliases"), F.array_join("chain", ">").alias("chain"), "problem")


@query(f"""WITH {FILES}, {EDGES}, i AS (SELECT DISTINCT a.path AS from_path, a.kind AS from_kind, b.path AS t, b.kind, CASE edge_type WHEN 'import' THEN '@all/' WHEN 're-export' THEN '@own/' ELSE '' END AS lead,
  CASE edge_type WHEN 're-export' THEN regexp_replace(regexp_replace(b.path, '^[^/]*/', ''), '\\.ts$', '') ELSE regexp_replace(b.path, '\\.ts$', '') END AS rest FROM edges JOIN files a ON a.id = src JOIN files b ON b.id = dst),
h AS (SELECT *, (lead = '@all/' AND from_kind <> 'PROMO') OR (lead = '@own/' AND from_kind = 'PROMO' AND kind = 'PROMO') AS aliased FROM i),
r AS (SELECT from_path, lead || rest AS specifier, max(CASE WHEN aliased OR lead = '' THEN t END) AS target, bool_or(lead = '@own/' AND from_kind = 'PROMO') AS own FROM h GROUP BY ALL)
SELECT from_path, specifier, target, target IS NOT NULL AS via_alias, CASE WHEN target IS NULL THEN CASE WHEN own THEN 'file-not-found' ELSE 'alias-not-configured' END END AS reason FROM r""")
def aliased_imports(spark, sf):
    """Imports through aliases and bases that configs inherit."""
    plain = F.regexp_replace("path", r"\.ts$", "")
    named = F.when(F.col("edge_type") == "import", F.concat(F.lit("@all/"), plain)).when(F.col("edge_type") == "re-export", F.concat(F.lit("@own/"), F.regexp_replace(plain, "^[^/]*/", ""))).otherwise(plain)
    configs = manifests.inherited_facts(_configs(spark, sf)).filter(F.col("config_path").endswith("tsconfig.json"))
    return resolve.resolved(_imports(spark, sf, named), source.files(spark, sf), configs=configs)


# Line ranges -------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT l_partkey AS file, l_orderkey AS commit, l_quantity::BIGINT AS n, sum(l_quantity::BIGINT) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS upto FROM lineitem),
b AS (SELECT file, commit, upto - n + 1 AS lo, upto AS hi FROM x), f AS (SELECT event_id, event_id % 150 + 1 AS file, event_id % 1777 + 1 AS line FROM events)
SELECT event_id, f.file, line, commit FROM f LEFT JOIN b ON b.file = f.file AND line BETWEEN lo AND hi""")
def blamed_findings(spark, sf):
    """Findings at a line with the commit whose lines these are; past a file's end with none."""
    from pyspark.sql.window import Window

    item = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("commit"), F.col("l_quantity").cast("long").alias("n"), "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    upto = F.sum("n").over(Window.partitionBy("file").orderBy("commit", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0))
    blame = item.withColumn("hi", upto).select("file", "commit", (F.col("hi") - F.col("n") + 1).alias("lo"), "hi")
    found = read(spark, sf, "events").select("event_id", (F.col("event_id") % 150 + 1).alias("file"), (F.col("event_id") % 1777 + 1).alias("line"))
    return ranges.in_ranges(found, blame, "file", "line", "lo", "hi").select("event_id", "file", "line", "commit")


# Imports of other languages ----------------------------------------------------------------------

_SCRIPT = """concat('import os, sys.path as p; import one\\n\"\"\"\\nimport hidden\\n\"\"\"\\nfrom .sib', cast(doc_id % 5 AS VARCHAR(2)), '.deep import (a,  # first\\n    b)\\nfrom pkg', cast(doc_id % 3 AS VARCHAR(2)), '.mod import x # c\\n', coalesce(text, ''), '\\nfrom .. import up, \\\\\\n  two as t\\n')"""


@query(f"""WITH d AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents),
r AS (SELECT doc_id, unnest([1, 1, 1, 5, 7, 8 + n, 8 + n]) AS line, unnest(['os', 'sys.path', 'one', './sib' || doc_id % 5 || '/deep', CASE doc_id % 3 WHEN 0 THEN '../lib/zero/mod' WHEN 1 THEN './one/mod' ELSE 'pkg2.mod' END, '../up', '../two']) AS specifier FROM d)
SELECT doc_id, line::INT AS line, specifier FROM r""")
def script_imports(spark, sf):
    """What documents import that have Python statements around their text, below two local packages."""
    docs = read(spark, sf, "documents").select("doc_id", F.expr(_SCRIPT).alias("text"))
    roots = spark.createDataFrame([("pkg0", "lib/zero"), ("pkg1", "app/one"), ("pkg", "far")], "name string, root string")
    found = imports.python_imports(docs, "doc_id").withColumn("path", F.lit("app/main.py"))
    return imports.below_roots(found, roots, ".").select("doc_id", "line", "specifier")


@query("""SELECT event_id, CASE WHEN props IS NULL OR trim(props) = '' OR event_id % 5 = 4 THEN 'empty' WHEN event_id % 5 = 3 THEN 'broken' WHEN event_id % 5 = 0 THEN 'valid' ELSE 'tolerant' END AS verdict FROM events""")
def json_diagnostics(spark, sf):
    """Whether events' JSON holds, where some got a comment, a trailing comma, or lost their end or all."""
    kind, props = F.col("event_id") % 5, F.col("props")
    inner = F.expr("left(props, length(props) - 1)")
    text = F.when(kind == 0, props).when(kind == 1, F.concat(inner, F.lit(", /* a, } */}"))).when(kind == 2, F.concat(F.lit("// {\n"), props)).when(kind == 3, inner).otherwise(F.lit(" \n"))
    return manifests.json_verdicts(read(spark, sf, "events").select("event_id", text.alias("text")), "event_id")
