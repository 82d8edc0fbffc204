"""Named queries over stored tables, review sections and manifests, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import patterns
from codeloom.functions.ids import under
from codeloom.operators import findings, graph, metrics, rules, sections, surface, upkeep
from codeloom.plans.queries import _DISMISSED, _SIDES, BACKWARD, CLOSURE, DEPS, EDGES, FILES, FINDINGS, FORWARD, ROOT, _day_graph, _dismissals, _levels, _sides, query
from codeloom.sources import files as files_of
from codeloom.sources import manifests
from codeloom.sources import projection as source
from codeloom.tables import read, stored

_CUT = "TIMESTAMP '2024-01-16'"


def _halves(spark, sf):
    """Findings of the former and the latter days."""
    found, cut = source.findings(spark, sf), F.lit("2024-01-16").cast("timestamp")
    return found.filter(F.col("found_at") < cut), found.filter(F.col("found_at") >= cut)


# Stored tables ----------------------------------------------------------------------------------


@query(f"""WITH {FILES}, {EDGES}, ch AS (SELECT id FROM files WHERE weight >= 46)
SELECT src, dst, edge_type, line, 2 AS scan FROM edges WHERE src NOT IN (SELECT id FROM ch) UNION ALL SELECT src, dst, edge_type, line, 2 FROM edges WHERE src IN (SELECT id FROM ch) AND day >= TIMESTAMP '1998-07-01'""")
def carried_edges(spark, sf):
    """Edges of changed files come from the new scan, all others are taken over."""
    e, changed = source.edges(spark, sf), source.files(spark, sf).filter("weight >= 46").select(F.col("id").alias("src"))
    new = e.filter(F.col("day") >= F.lit("1998-07-01").cast("timestamp")).join(changed, "src", "left_semi").select("src", "dst", "edge_type", "line", F.lit(2).alias("scan"))
    return upkeep.carried(e.select("src", "dst", "edge_type", "line", F.lit(1).alias("scan")), new, changed, "src", "scan", F.lit(2))


@query(f"WITH {FILES}, {EDGES} SELECT src, dst, line FROM edges WHERE src IN (SELECT id FROM files WHERE weight < 46)")
def unchanged_edges(spark, sf):
    kept = source.files(spark, sf).filter("weight < 46").select(F.col("id").alias("src"))
    return upkeep.owned_by(source.edges(spark, sf).select("src", "dst", "line"), kept, "src")


@query(f"WITH {FILES} SELECT id, path, weight = 49 AS is_entry FROM files")
def entry_marks(spark, sf):
    f = source.files(spark, sf)
    return upkeep.with_entries(f, f.filter("weight = 49")).select("id", "path", "is_entry")


@query(f"WITH {FILES} SELECT concat('f', l_orderkey, '_', l_linenumber) AS name, path FROM lineitem JOIN files ON id = l_partkey WHERE l_returnflag = 'A'")
def exported_symbols(spark, sf):
    name = F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
    symbols = read(spark, sf, "lineitem").select(name.alias("name"), F.col("l_partkey").alias("file_id"), (F.col("l_returnflag") == "A").alias("is_exported"), F.col("l_orderkey").alias("symbol_id"))
    return upkeep.exported_symbols(symbols, source.files(spark, sf)).select("name", "path")


@query("SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '26'")
def metadata_matches(spark, sf):
    return upkeep.json_equals(read(spark, sf, "events"), "props", "$.k", "26").select("event_id", "event_type")


@query("""WITH k AS (SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3)
SELECT o_custkey AS project, o_orderkey AS scan, count(l_orderkey) AS children FROM k LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def pruned_scans(spark, sf):
    scans = read(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("scan"), "o_orderdate")
    children = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scan"))
    kept, rows = upkeep.pruned(scans, children, "project", [F.desc("o_orderdate"), F.desc("scan")], 3, "scan")
    return kept.join(rows.groupBy("scan").agg(F.count("*").alias("n")), "scan", "left").select("project", "scan", F.coalesce("n", F.lit(0)).alias("children"))


@query("SELECT o_custkey AS project, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS scan, max(o_orderdate) AS started_at FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def latest_completed(spark, sf):
    scans = read(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("scan"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"))
    return upkeep.latest(scans, "project", "started_at", "scan", "F").select("project", "scan", "started_at")


@query(f"WITH {FINDINGS}, {_DISMISSED} SELECT finding_type, count(*) AS findings FROM findings f LEFT JOIN dis d USING (project, finding_type, fingerprint) WHERE d.project IS NULL GROUP BY finding_type")
def undismissed_counts(spark, sf):
    found = source.findings(spark, sf)
    return upkeep.undismissed_counts(found, _dismissals(found))


@query(f"""WITH {FINDINGS}, {_DISMISSED}, more AS (SELECT project, finding_type, fingerprint FROM dis UNION SELECT project, finding_type, fingerprint FROM findings WHERE severity = 'info' AND finding_type = 'click')
SELECT * FROM more WHERE NOT (finding_type = 'view' AND project % 2 = 0)""")
def dismissal_changes(spark, sf):
    found = source.findings(spark, sf)
    some = upkeep.dismissed(_dismissals(found), found.filter("severity = 'info' AND finding_type = 'click'"))
    return upkeep.undismissed(some, found.filter("finding_type = 'view' AND project % 2 = 0"))


@query(f"""WITH {FINDINGS}, {_DISMISSED} SELECT finding_id, severity, title, d.project IS NOT NULL AS dismissed FROM findings f LEFT JOIN dis d USING (project, finding_type, fingerprint) WHERE finding_type = 'view' AND d.project IS NOT NULL""")
def dismissed_findings(spark, sf):
    found = source.findings(spark, sf)
    return upkeep.listed_findings(found, _dismissals(found), "view", True).select("finding_id", "severity", "title", "dismissed")


@query("SELECT s_name AS name, s_suppkey AS id FROM supplier WHERE s_acctbal > 0")
def enabled_rules(spark, sf):
    rules = read(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("enabled"))
    return upkeep.named_rows(rules, enabled=True).select("name", "id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def reports_left(spark, sf):
    gone = read(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return upkeep.without(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY user_id)
SELECT user_id, kind <> 'view' AS compatible, CASE WHEN kind <> 'view' THEN json_extract_string(props, '$.k')::INT END AS k FROM l""")
def latest_reviews(spark, sf):
    """Each user's last event as the stored review; those of the kind view have another schema."""
    e = upkeep.latest(read(spark, sf, "events"), "user_id", "ts", "event_id")
    text = F.concat(F.lit('{"schemaVersion":'), F.when(F.col("event_type") == "view", "2").otherwise("1"), F.lit(","), F.substring("props", 2, 1 << 30))
    got = upkeep.readable_reviews(e.withColumn("text", text), "text", 1, "schemaVersion int, k int", ["k"])
    return got.select("user_id", "compatible", F.col("review.k").alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'failed' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '2001-01-01' ELSE o_orderdate END AS completed_at FROM orders")
def interrupted_scans(spark, sf):
    scans = read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "running").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").alias("completed_at"))
    return upkeep.interrupted(scans, F.lit("2001-01-01").cast("timestamp"))


@query(f"""WITH {FINDINGS}, f AS (SELECT *, project::VARCHAR AS path FROM findings)
SELECT finding_id, path FROM f WHERE found_at >= {_CUT} OR (finding_type IN ('view', 'click') AND path IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal > 0))""")
def carried_findings(spark, sf):
    b, a = (h.select("finding_id", "finding_type", F.col("project").cast("string").alias("path")) for h in _halves(spark, sf))
    same = read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("path"))
    return upkeep.carried_findings(b, a, same, ["view", "click"]).select("finding_id", "path")


@query(f"WITH {FINDINGS} SELECT finding_id, fingerprint FROM findings WHERE found_at >= {_CUT} AND fingerprint NOT IN (SELECT fingerprint FROM findings WHERE found_at < {_CUT})")
def new_to_baseline(spark, sf):
    b, a = _halves(spark, sf)
    return upkeep.without(a.select("finding_id", "fingerprint"), b, ["fingerprint"])


# Review sections --------------------------------------------------------------------------------

_FINDING_SECTION = f"""{FINDINGS}, k AS (SELECT sha256(concat('{{"findingType":"', finding_type, '","fingerprint":"', fingerprint, '"}}')) AS stable_key, finding_type, fingerprint, min(severity) AS severity,
  bool_or(found_at < {_CUT}) AS b, bool_or(found_at >= {_CUT}) AS a FROM findings GROUP BY finding_type, fingerprint),
sec AS (SELECT stable_key, CASE WHEN a THEN 'introduced' ELSE 'resolved' END AS direction, finding_type, fingerprint, severity FROM k WHERE a <> b)"""


def _finding_section(spark, sf):
    b, a = (h.select("finding_type", "fingerprint", "severity") for h in _halves(spark, sf))
    return sections.section_delta(b, a, sections.finding_key(), "findings")


@query(f"WITH {_FINDING_SECTION} SELECT * FROM sec")
def finding_section(spark, sf):
    return _finding_section(spark, sf)


@query(f"WITH {_FINDING_SECTION} SELECT * FROM sec WHERE direction = 'introduced' AND severity IN ('high', 'info')")
def finding_section_filtered(spark, sf):
    return sections.filtered(_finding_section(spark, sf), "findings", {"deltaDirections": ["introduced"], "severities": ["high", "info"], "findingTypes": []})


_EDGE_SECTION = f"""{FILES}, {EDGES}, n AS (SELECT x.path AS from_path, y.path AS to_path, edge_type, edge_type = 're-export' AS type_only, day < TIMESTAMP '1998-07-01' AS b FROM edges JOIN files x ON x.id = src JOIN files y ON y.id = dst),
k AS (SELECT from_path, to_path, edge_type, type_only, bool_or(b) AS b, bool_or(NOT b) AS a FROM n GROUP BY ALL),
sec AS (SELECT sha256(concat('{{"edgeType":"', edge_type, '","fromPath":"', from_path, '","toPath":"', to_path, '","typeOnly":', CASE WHEN type_only THEN 'true' ELSE 'false' END, '}}')) AS stable_key,
  CASE WHEN a THEN 'added' ELSE 'removed' END AS direction, from_path, to_path, edge_type, type_only FROM k WHERE a <> b)"""


def _edge_section(spark, sf):
    names = source.files(spark, sf).select("id", "path")
    x, y = names.select(F.col("id").alias("src"), F.col("path").alias("from_path")), names.select(F.col("id").alias("dst"), F.col("path").alias("to_path"))
    b, a = (e.join(x, "src").join(y, "dst").select("from_path", "to_path", "edge_type", (F.col("edge_type") == "re-export").alias("type_only")) for e in _sides(spark, sf))
    return sections.section_delta(b, a, sections.edge_key(), "edges")


@query(f"WITH {_EDGE_SECTION} SELECT * FROM sec")
def edge_section(spark, sf):
    return _edge_section(spark, sf)


@query(f"WITH {_EDGE_SECTION} SELECT * FROM sec WHERE direction = 'removed' AND starts_with(from_path, 'ECONOMY/')")
def edge_section_filtered(spark, sf):
    return sections.filtered(_edge_section(spark, sf), "edges", {"deltaDirections": ["removed"], "folderPrefix": "ECONOMY"}, "from_path")


_LIMITS = """l AS (SELECT event_type AS scope, json_extract_string(props, '$.k') AS code, list_sort(list_distinct(['p' || (user_id % 3), 'p' || (event_id % 3)])) AS paths, 'm' || (event_id % 5) AS message, user_id AS omitted FROM events)"""


@query(f"""WITH {_LIMITS} SELECT sha256(concat('{{"code":"', code, '","paths":["', array_to_string(paths, '","'), '"],"scope":"', scope, '"}}')) AS stable_key, scope, code, array_to_string(paths, ',') AS paths, min(message) AS message, max(omitted) AS omitted FROM l GROUP BY scope, code, l.paths""")
def merged_limitations(spark, sf):
    part = lambda c: F.concat(F.lit("p"), (F.col(c) % 3).cast("string"))
    rows = read(spark, sf, "events").select(F.col("event_type").alias("scope"), F.get_json_object("props", "$.k").alias("code"), F.array(part("user_id"), part("event_id")).alias("paths"), F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")).alias("message"), F.col("user_id").alias("omitted"))
    return sections.merged_limitations(rows).withColumn("paths", F.array_join("paths", ","))


@query(f"""WITH {FINDINGS} SELECT title AS text, min(finding_id) AS "at" FROM findings GROUP BY title ORDER BY "at" LIMIT 500""")
def first_limitations(spark, sf):
    return sections.first_limitations(source.findings(spark, sf).select(F.col("title").alias("text"), F.col("finding_id").alias("at")))


@query(f"WITH {EDGES}, {_SIDES} SELECT src, dst, CASE WHEN bool_or(b) THEN 'structure' ELSE 'impact' END AS kind FROM (SELECT src, dst, true AS b FROM bef UNION ALL SELECT src, dst, false FROM aft) GROUP BY src, dst")
def united_evidence(spark, sf):
    b, a = _sides(spark, sf)
    return sections.united_evidence(b.select("src", "dst", F.lit("structure").alias("kind")), a.select("src", "dst", F.lit("impact").alias("kind")), ["src", "dst"])


@query("""WITH x AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS t1, arg_max(event_type, (ts, event_id)) AS t2, arg_min(props, (ts, event_id)) AS p1, arg_max(props, (ts, event_id)) AS p2, arg_min(event_id % 9 = 0, (ts, event_id)) AS v1, arg_max(event_id % 9 = 0, (ts, event_id)) AS v2 FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN v1 <> v2 THEN 'incompatible' WHEN t1 <> t2 OR p1 <> p2 THEN 'stale' ELSE 'current' END AS freshness, CASE WHEN v1 = v2 THEN concat_ws(',', CASE WHEN t1 <> t2 THEN 'tree-changed' END, CASE WHEN p1 <> p2 THEN 'configuration-changed' END) ELSE '' END AS reasons FROM x""")
def review_freshness(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_type", "props", (F.col("event_id") % 9 == 0).alias("version"), F.struct("ts", "event_id").alias("at"))
    first, last = (e.groupBy("user_id").agg(*(f(c, "at").alias(c) for c in ("event_type", "props", "version"))) for f in (F.min_by, F.max_by))
    return sections.freshness(first, last, "user_id", {"event_type": "tree-changed", "props": "configuration-changed"}, "version").withColumn("reasons", F.array_join("reasons", ","))


@query("""SELECT l_orderkey, sha256(string_agg(sha256(concat('{"l_partkey":', l_partkey, ',"l_suppkey":', l_suppkey, '}')), chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey)) AS fingerprint FROM lineitem GROUP BY l_orderkey""")
def tree_fingerprints(spark, sf):
    return sections.tree_fingerprint(read(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_partkey", "l_suppkey"])


@query(f"""WITH {FINDINGS} SELECT finding_id, finding_type FROM findings WHERE list_bool_or([contains(x, '7') FOR x IN ['file:' || project, 'file:' || title]])""")
def report_scope(spark, sf):
    related = F.array(F.concat(F.lit("file:"), F.col("project").cast("string")), F.concat(F.lit("file:"), "title"))
    return findings.in_scope(source.findings(spark, sf).withColumn("related", related), "file", "7").select("finding_id", "finding_type")


# Manifests and source facts ---------------------------------------------------------------------

_INSTALLED = """m AS (SELECT c_name AS package, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE '1.' || c_nationkey END AS version, CASE WHEN c_acctbal > 0 THEN 'MIT' END AS license FROM customer)"""


@query(f"WITH {_INSTALLED} SELECT n.package, version, license FROM (SELECT DISTINCT c_name AS package FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) ORDER BY 1 LIMIT 400) n LEFT JOIN m USING (package)")
def licence_inventory(spark, sf):
    """The reference's own bound of 400 packages holds."""
    c = read(spark, sf, "customer")
    version = F.when(F.col("c_nationkey") % 4 == 0, "3").otherwise(F.concat(F.lit('"1.'), F.col("c_nationkey").cast("string"), F.lit('"')))
    text = F.concat(F.lit('{"name":"x","version":'), version, F.lit(',"license":'), F.when(F.col("c_acctbal") > 0, '"MIT"').otherwise('{"type":"MIT"}'), F.lit("}"))
    used = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().join(c, "c_custkey").select(F.concat("c_name", F.lit("/deep")).alias("specifier"))
    return manifests.licences(used, c.select(F.col("c_name").alias("package"), text.alias("text")), F.substring_index("specifier", "/", 1))


def _manifests(spark, sf):
    part = read(spark, sf, "part")
    text = F.concat(F.lit('{"main":"./lib/'), F.col("p_partkey").cast("string"), F.lit('.js","types":7,"exports":'), F.when(F.col("p_size") > 25, '{".":{"import":"./esm/a.mjs","require":{"node":"./cjs/a.cjs"}},"./x":"./x.js"}').otherwise('"./one.js"'), F.lit(',"bin":{"run":"./bin/run.js"}}'))
    return part.select("p_partkey", text.alias("text"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN '.,./x' ELSE './one.js' END || ',./lib/' || p_partkey || '.js' AS api FROM part")
def public_api(spark, sf):
    return manifests.public_api(_manifests(spark, sf), "p_partkey").withColumn("api", F.array_join("api", ","))


@query("SELECT p_partkey, unnest(['lib/' || p_partkey || '.js', 'bin/run.js'] || CASE WHEN p_size > 25 THEN ['esm/a.mjs', 'cjs/a.cjs', 'x.js'] ELSE ['one.js'] END) AS path FROM part")
def manifest_entries(spark, sf):
    return manifests.entry_paths(_manifests(spark, sf), "p_partkey")


@query("SELECT CASE WHEN lower(url) LIKE '%.html' THEN 'html' ELSE 'plaintext' END AS language, count(*) AS pages FROM pages GROUP BY 1")
def page_languages(spark, sf):
    return read(spark, sf, "pages").groupBy(manifests.language_of(F.col("url")).alias("language")).agg(F.count("*").alias("pages"))


@query(f"""WITH {FINDINGS}, f AS (SELECT project AS path, CASE finding_type WHEN 'error' THEN 'merge-conflict' WHEN 'click' THEN 'type-error' ELSE 'code-smell' END AS t, title, json_extract_string(props, '$.k')::INT AS s FROM findings JOIN events ON event_id = finding_id),
l AS (SELECT path, t, title, unnest(range(s, CASE WHEN t = 'merge-conflict' THEN s + 3 ELSE s + 1 END)) AS line FROM f WHERE t <> 'code-smell' AND s > 0)
SELECT path, line::INT AS line, CASE WHEN bool_or(t = 'merge-conflict') THEN 'conflict' ELSE 'broken' END AS kind, array_to_string(list_sort(list(DISTINCT title)), ',') AS titles FROM l GROUP BY path, line""")
def line_marks(spark, sf):
    kind = F.when(F.col("event_type") == "error", "merge-conflict").when(F.col("event_type") == "click", "type-error").otherwise("code-smell")
    at = F.get_json_object("props", "$.k").cast("int")
    rows = read(spark, sf, "events").select(F.col("user_id").alias("path"), kind.alias("finding_type"), F.concat("event_type", F.lit(" "), F.get_json_object("props", "$.k")).alias("title"), F.lit(False).alias("dismissed"), at.alias("start_line"), (at + 2).alias("end_line"))
    return manifests.line_marks(rows).withColumn("titles", F.array_join("titles", ","))


@query(f"""WITH {FILES} SELECT count(*) AS entries, sum(CASE WHEN weight % 10 > 1 THEN size_bytes ELSE 0 END)::BIGINT AS bytes, count(*) FILTER (weight % 10 = 0) AS links, count(*) FILTER (weight % 10 = 1) AS submodules,
0 AS collisions, count(*) <= 100000 AND sum(CASE WHEN weight % 10 > 1 THEN size_bytes ELSE 0 END) <= 2147483648 AS fits FROM files""")
def tree_preflight(spark, sf):
    mode = F.when(F.col("weight") % 10 == 0, "120000 blob").when(F.col("weight") % 10 == 1, "160000 commit").otherwise("100644 blob")
    size = F.when(F.col("weight") % 10 == 1, "-").otherwise(F.col("size_bytes").cast("string"))
    records = source.files(spark, sf).select(F.concat(mode, F.lit(" "), F.sha2("path", 256), F.lit("   "), size, F.lit("\t"), "path").alias("value"))
    return manifests.preflight(manifests.tree_entries(records))


@query(f"""WITH {FILES} SELECT path, unnest(list_filter([CASE WHEN path LIKE '%.test.ts' THEN 'test' END, CASE WHEN starts_with(path, 'PROMO/') THEN 'user-exclude' END, CASE WHEN size_bytes > 10000 THEN 'oversize' END], lambda x: x IS NOT NULL)) AS kind FROM files""")
def exclusion_kinds(spark, sf):
    p = F.col("path")
    return manifests.exclusion_log(source.files(spark, sf), {"test": patterns.is_test(p), "user-exclude": under(p, "PROMO"), "oversize": F.col("size_bytes") > 10_000})


# Impact and exports -----------------------------------------------------------------------------


def _graph(spark, sf):
    deps, files = stored(source.dependencies(spark, sf), "deps"), source.files(spark, sf)
    tests = files.filter(patterns.is_test(F.col("path"))).select(F.col("id").alias("node"))
    return deps, files, tests, files.filter("is_entry").select(F.col("id").alias("node"))


_CYCLIC = "cyc AS (SELECT DISTINCT x.a AS node FROM closure x WHERE x.a = x.b)"


@query(f"""WITH RECURSIVE {FILES}, {EDGES}, {DEPS}, {CLOSURE}, {_CYCLIC}, {BACKWARD}, {_levels('be', 'SELECT id AS node FROM files WHERE weight IN (9, 31)', 8)}
SELECT node, depth, path_ LIKE '%.test.ts' AS is_test, is_entry, node IN (SELECT node FROM cyc) AS in_cycle FROM (SELECT node, depth FROM seen WHERE depth > 0 ORDER BY depth, node LIMIT 2000) JOIN (SELECT id, path AS path_, is_entry FROM files) ON id = node""")
def diff_impact(spark, sf):
    """25 levels deep; the SQL's 8 reach all that there is."""
    deps, files, tests, entries = _graph(spark, sf)
    return surface.diff_impact(deps, files.filter("weight IN (9, 31)").select(F.col("id").alias("node")), tests, entries, graph.strong_components(deps))


@query(f"""WITH RECURSIVE {FILES}, {EDGES}, {DEPS}, {CLOSURE}, f AS ({ROOT}), r(node) AS (SELECT node FROM f UNION SELECT src FROM r JOIN deps ON dst = node)
SELECT (SELECT node FROM f) AS node, count(*) - 1 AS dependents, count(*) FILTER (path LIKE '%.test.ts' AND node <> (SELECT node FROM f)) AS tests, count(*) FILTER (is_entry) AS entries, EXISTS (SELECT 1 FROM closure WHERE a = b AND a = (SELECT node FROM f)) AS in_cycle,
(SELECT count(*) FROM deps WHERE dst = (SELECT node FROM f)) AS fan_in, (SELECT count(*) FROM deps WHERE src = (SELECT node FROM f)) AS fan_out FROM r JOIN files ON id = node""")
def file_detail(spark, sf):
    deps, _, tests, entries = _graph(spark, sf)
    return surface.file_detail(deps, entries.agg(F.min("node").alias("node")), tests, entries)


@query(f"""WITH {FILES}, {EDGES}, {DEPS}, {FORWARD}, {BACKWARD}, a AS (WITH {_levels('fe', ROOT, 2)} SELECT node, 'dependencies' AS way FROM seen WHERE depth > 0), b AS (WITH {_levels('be', ROOT, 2)} SELECT node, 'dependents' AS way FROM seen WHERE depth > 0)
SELECT node, array_to_string(list_sort(list(DISTINCT way)), '+') AS directions FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY node""")
def focus_both_ways(spark, sf):
    root = source.files(spark, sf).filter("is_entry").agg(F.min("id").alias("node"))
    return surface.both_directions(source.dependencies(spark, sf), root, 2)


@query(f"""WITH RECURSIVE {FILES}, {EDGES}, l AS (SELECT DISTINCT src, dst FROM edges WHERE unresolved AND edge_type = 're-export'),
o(module, name, origin) AS (SELECT id, name, id FROM files UNION SELECT l.src, o.name, o.origin FROM o JOIN l ON l.dst = o.module JOIN files f ON f.id = l.src WHERE f.name <> o.name),
g AS (SELECT module, name, count(DISTINCT origin) AS n, min(origin) AS origin FROM o WHERE module IN (SELECT id FROM files WHERE weight >= 40) GROUP BY module, name)
SELECT module AS entry_point, name AS exported_name, CASE WHEN n = 1 THEN origin END AS origin, CASE WHEN n = 1 THEN name END AS origin_name, n > 1 AS ambiguous FROM g""")
def reachable_exports(spark, sf):
    f = source.files(spark, sf)
    links = source.edges(spark, sf).filter("unresolved AND edge_type = 're-export'").select(F.col("src").alias("module"), F.col("dst").alias("target"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("imported"))
    return surface.reachable_exports(f.filter("weight >= 40").select(F.col("id").alias("module")), f.select(F.col("id").alias("module"), "name"), links)


@query()
def shortest_cycles(spark, sf):
    edges = _day_graph(spark, sf)
    return graph.representative_cycle(edges, graph.strong_components(edges)).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


# Policies ---------------------------------------------------------------------------------------

_STATUS = "CASE weight % 7 WHEN 0 THEN 'eligible' WHEN 1 THEN 'text-only' WHEN 2 THEN 'binary' WHEN 3 THEN 'excluded' WHEN 4 THEN 'oversize' WHEN 5 THEN 'unreadable' ELSE 'symlink' END"


@query(f"""WITH {FILES}, f AS (SELECT *, {_STATUS} AS status FROM files) SELECT kind, count(*) AS total, count(*) FILTER (status = 'eligible') AS eligible, count(*) FILTER (status = 'text-only') AS text_only, count(*) FILTER (status = 'binary') AS binary,
count(*) FILTER (status = 'excluded') AS excluded, count(*) FILTER (status = 'oversize') AS oversize, count(*) FILTER (status = 'unreadable') AS unreadable, count(*) FILTER (status = 'symlink') AS symlink,
count(*) FILTER (path LIKE '%.test.ts') AS git_ignored, count(*) FILTER (is_entry) AS user_excluded FROM f GROUP BY kind""")
def capability_counts(spark, sf):
    f = source.files(spark, sf).withColumn("status", F.expr(_STATUS)).withColumn("git_ignored", patterns.is_test(F.col("path"))).withColumn("user_excluded", F.col("is_entry"))
    return metrics.capability_counts(f, "kind")


@query(f"""WITH {FILES} SELECT path, CASE WHEN starts_with(path, 'ECONOMY/') THEN contains(path, '/Brand#1') AND NOT contains(path, '/Brand#12/') WHEN starts_with(path, 'PROMO/') AND path LIKE '%.test.ts' THEN true ELSE contains(path, '/Brand#1') AND NOT contains(path, '/Brand#1/') END AS ignored FROM files""")
def layered_ignores(spark, sf):
    f = source.files(spark, sf)
    text = F.when(F.col("kind") == "ECONOMY", "Brand#1*/\n!Brand#12/").when(F.col("kind") == "PROMO", "# tests\n*.test.ts").otherwise("# nothing")
    own = f.select(F.col("kind").alias("folder"), text.alias("text")).distinct()
    root = f.agg(F.min("kind").alias("k")).select(F.lit("").alias("folder"), F.lit("Brand#1?/").alias("text"))
    return rules.layered_ignores(f.select("path"), own.unionByName(root))


@query(f"WITH {FILES} SELECT path, starts_with(path, 'PROMO/') OR regexp_matches(path, '^[^/]*/Brand#2[^/]*/') AS excluded FROM files")
def user_exclusions(spark, sf):
    return source.files(spark, sf).select("path", rules.excluded_by_user(F.col("path"), ["PROMO", "*/Brand#2*"]).alias("excluded"))


# Views ------------------------------------------------------------------------------------------


_INSIDE = "SELECT id FROM files WHERE is_entry AND kind = 'ECONOMY'"


@query(f"""WITH {FILES}, {EDGES}, {DEPS} SELECT DISTINCT src, dst FROM deps JOIN files a ON a.id = src JOIN files b ON b.id = dst WHERE starts_with(a.path, 'ECONOMY/') AND starts_with(b.path, 'ECONOMY/')
AND src IN (SELECT dst FROM deps WHERE src IN ({_INSIDE}) UNION SELECT src FROM deps WHERE dst IN ({_INSIDE}) UNION {_INSIDE}) AND dst IN (SELECT dst FROM deps WHERE src IN ({_INSIDE}) UNION SELECT src FROM deps WHERE dst IN ({_INSIDE}) UNION {_INSIDE})""")
def focused_slice(spark, sf):
    """A folder's part of what is next to the entries in it, all of it."""
    f = source.files(spark, sf)
    return graph.graph_slice(source.dependencies(spark, sf), f, "ECONOMY", f.filter("is_entry AND kind = 'ECONOMY'").select(F.col("id").alias("node")), 1, cap=None)[0]


@query(f"""WITH {FILES}, {EDGES} SELECT src, dst, edge_type = 're-export' AS type_only, line FROM edges WHERE edge_type <> 're-export' AND src NOT IN (SELECT id FROM files WHERE weight < 10) AND dst NOT IN (SELECT id FROM files WHERE weight < 10)""")
def edge_view(spark, sf):
    f = source.files(spark, sf).withColumn("path", F.when(F.col("weight") < 10, F.concat("kind", F.lit("/index.ts"))).otherwise(F.col("path")))
    e = source.edges(spark, sf).select("src", "dst", (F.col("edge_type") == "re-export").alias("type_only"), "line")
    return graph.viewed(e, f)


@query(f"WITH {_EDGE_SECTION} SELECT from_path, to_path, edge_type, direction FROM sec ORDER BY from_path, to_path, edge_type, direction LIMIT 2000")
def edge_section_kept(spark, sf):
    """What a review keeps of a section."""
    return findings.retained(_edge_section(spark, sf), ["from_path", "to_path", "edge_type"])[0].select("from_path", "to_path", "edge_type", "direction")


@query(r"""SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN strlen(text) > 4096 THEN 'oversize' WHEN len(regexp_split_to_array(text, '\r?\n')) > 20 THEN 'too-many-lines' END AS unavailable, len(regexp_split_to_array(text, '\r?\n'))::INT AS lines FROM documents""")
def guarded_texts(spark, sf):
    """With smaller bounds than a viewer's 1 MiB and 8,000 lines, as the texts are short."""
    return files_of.guarded_text(read(spark, sf, "documents"), max_bytes=4096, max_lines=20).select("doc_id", "unavailable", "lines")
