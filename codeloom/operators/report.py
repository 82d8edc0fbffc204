"""Reports from aggregates that are small by construction."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def section(title: str, rows: DataFrame, limit: int = 50) -> dict:
    """A report's section: a table of the first rows, and whether there are more."""
    got = rows.limit(limit + 1).collect()
    return {"title": title, "columns": rows.columns, "rows": [list(r) for r in got[:limit]], "truncated": len(got) > limit}


def markdown(sections: list[dict]) -> str:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    out = []
    for s in sections:
        out += [f"## {s['title']}", "", "| " + " | ".join(s["columns"]) + " |", "|" + " --- |" * len(s["columns"])]
        out += ["| " + " | ".join(map(cell, r)) + " |" for r in s["rows"]]
        out += [*(["", "More rows are left out."] if s["truncated"] else []), ""]
    return "\n".join(out)


def html(sections: list[dict]) -> str:
    from html import escape

    cell = lambda tag, v: f"<{tag}>{escape('' if v is None else str(v))}</{tag}>"
    body = "".join(f"<h2>{escape(s['title'])}</h2><table><tr>{''.join(cell('th', c) for c in s['columns'])}</tr>{''.join('<tr>' + ''.join(cell('td', v) for v in r) + '</tr>' for r in s['rows'])}</table>" for s in sections)
    return f"<!doctype html><meta charset=utf-8><title>Report</title>{body}"


def as_json(sections: list[dict]) -> str:
    return json.dumps({"sections": sections}, default=str, ensure_ascii=False)


def sarif(found: DataFrame) -> DataFrame:
    """Findings (finding_type, severity, title, path, line, fingerprint) as SARIF results, one JSON
    text a row; write.text() puts them to files without the driver."""
    level = F.when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.col("line"), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("finding_type").alias("ruleId"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("fingerprint").alias("codeloom/v1")).alias("partialFingerprints"))
    return found.select(F.to_json(result).alias("value"))


# Whole reports ----------------------------------------------------------------------------------

# What is taken out of texts of a report, in this order, and what stands in its place.
REMOVED = (
    ("\u001b\\[[0-?]*[ -/]*[@-~]", ""),
    ("(?i)https?://[^\\s<>'\"]+", "[remote URL removed]"),
    ("(?i)\\b(?:api[-_ ]?key|token|password|secret)\\s*[:=]\\s*[^\\s,;]+", "[credential removed]"),
    ("\\b[A-Za-z]:[\\\\/][^\\s<>'\"),;]*", "[absolute path removed]"),
    ("(^|[\\s(\"'=])/(?:[^\\s<>'\"),;]+/?)+", "$1[absolute path removed]"),
    ("[\u0000-\u001f\u007f-\u009f]+", " "),
    ("(?U)\\s+", " "),
)
# Fixed value: what a path is called that is not below the project's root.
NO_PATH = "[invalid relative path]"


def safe_text(text: Column) -> Column:
    """A text without machine paths, addresses, credentials and control characters."""
    for pattern, instead in REMOVED:
        text = F.regexp_replace(text, pattern, instead)
    return F.trim(text)


def safe_path(path: Column) -> Column:
    """A path below the root with forward slashes, as a safe text; NO_PATH for any other. Null stays."""
    plain = F.replace(F.trim(F.regexp_replace(path, REMOVED[5][0], " ")), F.lit("\\"), F.lit("/"))
    parts = F.split(plain, "/")
    outside = plain.rlike("^(/|[A-Za-z]:(/|$)|(?i:https?://))") | F.exists(parts, lambda p: p.isin("", ".", ".."))
    safe = safe_text(plain)
    return F.when(path.isNotNull(), F.when(outside | (safe == ""), NO_PATH).otherwise(safe))


def sanitised(rows: DataFrame) -> DataFrame:
    """The rows with safe texts, and safe paths in columns whose name ends in path or paths."""

    def safe(name: str, kind: str) -> Column:
        one = safe_path if name.lower().endswith(("path", "paths")) else safe_text
        if kind == "string":
            return one(F.col(f"`{name}`")).alias(name)
        return F.transform(f"`{name}`", one).alias(name) if kind == "array<string>" else F.col(f"`{name}`")

    return rows.select(*(safe(n, k) for n, k in rows.dtypes))


# The sections of a project's report, in order.
SECTIONS = ("summary", "cycles", "unused-exports", "architecture-violations", "unresolved-imports", "type-errors", "top-impact-files", "blast-radius", "limitations", "changed-since-scan")
# Types of findings.
FINDING_TYPES = ("circular-dependency", "unused-export-candidate", "architecture-violation", "unresolved-import", "type-error", "syntax-error", "merge-conflict", "todo-comment", "duplicate-code", "complexity-hotspot")


def project_report(tables: dict[str, DataFrame], chosen: list[str] | None = None, limit: int = 200) -> list[dict]:
    """The report's sections, in their order, of those chosen that there is a table for. The first
    limit rows of a table are shown, and its title tells how many there are."""
    wanted = set(SECTIONS if chosen is None else chosen)
    if wanted - set(SECTIONS):
        raise ValueError(f"no such section: {sorted(wanted - set(SECTIONS))}")
    out = []
    for name in SECTIONS:
        if name in wanted and name in tables:
            s = section(name, tables[name], limit)
            total = tables[name].count() if s["truncated"] else len(s["rows"])
            out.append(s | {"title": f"{name.replace('-', ' ').capitalize()} ({total})", "total": total})
    return out


def review_report(sections: dict[str, DataFrame], freshness: str, reasons: list[str], form: str, limit: int = 2000) -> str:
    """A review as text, markdown, json or html: a table for each section, its texts and paths sanitised,
    with how many rows it has and a warning unless the review is current. An incompatible review is not reported."""
    if freshness == "incompatible":
        raise ValueError("the review is incompatible")
    parts = []
    for name, rows in sections.items():
        s = section(name, sanitised(rows), limit)
        parts.append(s | {"total": rows.count() if s["truncated"] else len(s["rows"])})
    warning = None if freshness == "current" else f"WARNING: This review is stale ({', '.join(sorted(set(reasons))) or 'reason unavailable'}). It does not describe the current working tree."
    if form == "json":
        return json.dumps({"freshness": freshness, "warning": warning, "sections": parts}, default=str, ensure_ascii=False, indent=2)
    if form == "html":
        return html([*([{"title": warning, "columns": [], "rows": [], "truncated": False}] if warning else []), *parts])
    if form == "markdown":
        return "\n".join([*([f"> {warning}", ""] if warning else []), markdown([s | {"title": f"{s['title']} ({s['total']})"} for s in parts])])
    if form == "text":
        lines = [warning] if warning else []
        for s in parts:
            lines += [f"{s['title']}: {s['total']}", *("  " + "  ".join("" if v is None else str(v) for v in r) for r in s["rows"])]
        return "\n".join(lines) + "\n"
    raise ValueError(f"no form {form}")


def sarif_document(found: DataFrame, limit: int = 25_000) -> str:
    """A SARIF 2.1.0 document of findings (finding_type, title, description), of up to limit, counted as
    they come; more are an error, and are written as rows of sarif() instead."""
    rows = found.select("finding_type", "title", "description").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} findings do not go into one document")
    results = [{"ruleId": r.finding_type, "level": "warning", "message": {"text": f"{r.title}. {r.description or ''}"}} for r in rows]
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "codeloom"}}, "results": results}]}, indent=2)


def write_baseline(found: DataFrame, path: str) -> None:
    """The distinct fingerprints of findings as JSON lines, written by Spark."""
    found.select("fingerprint").distinct().write.mode("overwrite").json(path)


def beyond_baseline(found: DataFrame, path: str) -> DataFrame:
    """The findings whose fingerprint the baseline at path does not hold; all, if there is none."""
    from pyspark.errors import AnalysisException

    try:
        known = found.sparkSession.read.schema("fingerprint string").json(path)
    except AnalysisException:
        return found
    return found.join(known.distinct(), "fingerprint", "left_anti")
