"""Named queries over what a project holds: entries, evidence, states of contents, the dashboard; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import report, rules, sections
from codeloom.plans.queries import _SCORES, EDGES, FILES, FINDINGS, _scores, query
from codeloom.sources import files as files_of
from codeloom.sources import projection as source
from codeloom.tables import read

_HALF = "TIMESTAMP '2024-01-16'"


@query(f"""WITH {FILES}, {EDGES}, r AS (SELECT dst FROM edges WHERE edge_type = 're-export' AND unresolved)
SELECT 'named' AS project, id, false AS inferred FROM files WHERE weight IN (11, 12) UNION ALL SELECT 'bare', id, true FROM files WHERE id NOT IN (SELECT dst FROM r)""")
def project_entries(spark, sf):
    """Entries of a project whose manifest names files that exist, and of one whose names lead nowhere."""
    f = source.files(spark, sf)
    led = source.edges(spark, sf).filter("edge_type = 're-export' AND unresolved")
    lost = f.select(F.concat("path", F.lit(".lost")).alias("path"))
    projects = {"named": f.filter("weight IN (11, 12)").select("path").unionByName(lost), "bare": lost}
    parts = [rules.entry_points(f, named, led).withColumn("project", F.lit(name)) for name, named in projects.items()]
    return parts[0].unionByName(parts[1]).select("project", "id", "inferred")


@query(f"""WITH {FILES}, {EDGES} SELECT a.path AS from_path, b.path AS to_path, edge_type, edge_type = 're-export' AS type_only, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines, array_to_string(list_sort(list(DISTINCT concat('../../', b.kind, '/', b.id, CASE WHEN line % 2 = 0 THEN '.js' ELSE '' END))), ',') AS specifiers
FROM edges JOIN files a ON a.id = src JOIN files b ON b.id = dst GROUP BY a.path, b.path, edge_type""")
def normalised_evidence(spark, sf):
    f = source.files(spark, sf)
    a, b = f.select(F.col("id").alias("src"), F.col("path").alias("from_path")), f.select(F.col("id").alias("dst"), F.col("path").alias("to_path"), "kind")
    named = F.concat(F.lit("../../"), F.col("kind"), F.lit("/"), F.col("dst").cast("string"), F.when(F.col("line") % 2 == 0, ".js").otherwise(""))
    e = source.edges(spark, sf).join(a, "src").join(b, "dst").withColumn("specifier", named).withColumn("type_only", F.col("edge_type") == "re-export")
    out = sections.normalised_evidence(e)
    return out.withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",")).withColumn("specifiers", F.array_join("specifiers", ","))


@query("""WITH t AS (SELECT doc_id, text, doc_id % 4 AS r FROM documents)
SELECT doc_id AS path, CASE WHEN r <> 3 THEN sha256(text) END AS content_hash, CASE WHEN r = 3 THEN 'gone' WHEN r = 2 THEN 'new' WHEN r = 1 OR text IS NULL THEN 'changed' ELSE 'unchanged' END AS state FROM t""")
def content_states(spark, sf):
    """Texts against stored hashes: a quarter each the same, changed, new and gone."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text", (F.col("doc_id") % 4).alias("r"))
    known = d.filter("r <> 2").select("path", F.sha2(F.concat(F.col("text"), F.when(F.col("r") == 1, " ").otherwise("")), 256).alias("content_hash"))
    return files_of.content_states(d.filter("r <> 3"), known)


_KINDS = ("click", "error", "purchase", "signup", "view")
_LEVELS = ("high", "medium", "low", "info")


def _counts_sql() -> str:
    return ", ".join([*(f"count(*) FILTER (finding_type = '{k}') AS {k}_findings" for k in _KINDS), *(f"count(*) FILTER (severity = '{s}') AS {s}_findings" for s in _LEVELS)])


@query(f"""WITH RECURSIVE {_SCORES}, {FINDINGS}, c AS (SELECT count(*) AS findings, {_counts_sql()} FROM findings),
h AS (SELECT fingerprint, bool_or(found_at < {_HALF}) AS b, bool_or(found_at >= {_HALF}) AS a, min(title) AS title FROM findings GROUP BY fingerprint),
x AS (SELECT count(*) FILTER (a AND NOT b) AS added, count(*) FILTER (b AND NOT a) AS removed, count(*) FILTER (a AND b) AS persisted FROM h),
t AS (SELECT array_to_string(list(title ORDER BY fingerprint), '|') AS added_titles FROM (SELECT * FROM h WHERE a AND NOT b ORDER BY fingerprint LIMIT 8)),
top AS (SELECT array_to_string(list(path ORDER BY score DESC, path), '|') AS top_files FROM (SELECT path, score FROM s JOIN files ON id = node ORDER BY score DESC, path LIMIT 10)),
n AS (SELECT count(*) AS files, count(*) FILTER (is_entry) AS entries, count(*) FILTER (size_bytes > 20000) AS large FROM files)
SELECT * FROM n, c, x, t, top""")
def dashboard_summary(spark, sf):
    """One row: inventory, ten counts of findings, how the latest scan differs, and the files of most impact."""
    f, found = source.files(spark, sf), source.findings(spark, sf)
    inventory = f.agg(F.count("*").alias("files"), F.count_if("is_entry").alias("entries"), F.count_if(F.col("size_bytes") > 20000).alias("large"))
    counts = found.agg(F.count("*").alias("findings"), *(F.count_if(F.col("finding_type") == k).alias(f"{k}_findings") for k in _KINDS), *(F.count_if(F.col("severity") == s).alias(f"{s}_findings") for s in _LEVELS))
    late = F.col("found_at") >= F.lit("2024-01-16").cast("timestamp")
    prints = found.groupBy("fingerprint").agg(F.bool_or(~late).alias("b"), F.bool_or(late).alias("a"), F.min("title").alias("title"))
    change = prints.agg(F.count_if(F.expr("a AND NOT b")).alias("added"), F.count_if(F.expr("b AND NOT a")).alias("removed"), F.count_if(F.expr("a AND b")).alias("persisted"))
    titles = prints.filter("a AND NOT b").orderBy("fingerprint").limit(8).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fingerprint", "title"))), lambda x: x["title"]), "|").alias("added_titles"))
    ranked = _scores(spark, sf).join(f.select(F.col("id").alias("node"), "path"), "node").select("path", "score").orderBy(F.desc("score"), "path").limit(10)
    top = ranked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "path"))), lambda x: x["path"]), "|").alias("top_files"))
    return inventory.crossJoin(counts).crossJoin(change).crossJoin(titles).crossJoin(top)  # single rows


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN concat('src/p', page_id, '.ts') WHEN 5 THEN concat('win/p', page_id, '.ts') WHEN 6 THEN 'a [credential removed]' WHEN 7 THEN concat('a b/', page_id) ELSE '[invalid relative path]' END AS path,
concat('see [remote URL removed] or [absolute path removed], [credential removed]; ', page_id) AS note FROM pages""")
def sanitised_rows(spark, sf):
    """Paths and notes of pages as a report may show them."""
    pid, url = F.col("page_id").cast("string"), F.regexp_extract("url", r"^[^\s<>'\"]+", 0)
    odd = [F.concat(F.lit("/etc/p"), pid), F.concat(F.lit("C:\\temp\\"), pid), url, F.concat(F.lit("a/../"), pid)]
    path = F.when(F.col("page_id") % 8 == 0, F.concat(F.lit("src/p"), pid, F.lit(".ts")))
    for k, c in enumerate(odd):
        path = path.when(F.col("page_id") % 8 == k + 1, c)
    path = path.when(F.col("page_id") % 8 == 5, F.concat(F.lit(" win\\p"), pid, F.lit(".ts"))).when(F.col("page_id") % 8 == 6, F.concat(F.lit("a token=t"), pid)).otherwise(F.concat(F.lit("a\t  b/"), pid))
    note = F.concat(F.lit("see  "), url, F.lit(" or /var/log/x.txt, password: hunter2; "), pid)
    return report.sanitised(read(spark, sf, "pages").select("page_id", path.alias("path"), note.alias("note")))
