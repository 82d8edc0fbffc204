"""python -m codeloom.cli FINDINGS [options]: new findings of a stored table, as text, JSON or SARIF."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codeloom.operators import report

MAX_DEPTH = 25


def _types(text: str) -> list[str]:
    types = [t.strip() for t in text.split(",") if t.strip()]
    wrong = [t for t in types if t not in report.FINDING_TYPES]
    if wrong or not types:
        raise argparse.ArgumentTypeError(f"finding types are {', '.join(report.FINDING_TYPES)}")
    return types


def _depth(text: str) -> int:
    if not text.isdecimal() or not 1 <= int(text) <= MAX_DEPTH:
        raise argparse.ArgumentTypeError(f"a whole number from 1 to {MAX_DEPTH}")
    return int(text)


def options(argv: list[str]) -> argparse.Namespace:
    """Parses and checks; options of a review need --review, which goes with no other option."""
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__, allow_abbrev=False)
    p.add_argument("findings", help="Parquet table: finding_type, title, description, fingerprint")
    scan = p.add_argument_group("findings")
    scan.add_argument("--fail-on", type=_types, action="extend", default=[])
    scan.add_argument("--format", choices=("text", "json", "sarif"))
    scan.add_argument("--baseline")
    scan.add_argument("--write-baseline", action="store_true")
    review = p.add_argument_group("review")
    review.add_argument("--review", help="folder of a review's sections, a Parquet table each")
    review.add_argument("--review-format", choices=("text", "json", "markdown", "html"))
    review.add_argument("--review-output")
    review.add_argument("--review-depth", type=_depth)
    got = p.parse_args(argv)
    if got.review and (got.fail_on or got.format or got.baseline or got.write_baseline):
        p.error("--review goes with no option of findings")
    if not got.review and (got.review_format or got.review_output or got.review_depth):
        p.error("options of a review need --review")
    if got.review_format == "html" and not got.review_output:
        p.error("an HTML report needs --review-output")
    if got.write_baseline and not got.baseline:
        p.error("--write-baseline needs --baseline")
    return got


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    """0, or 1 if a new finding is of a type that --fail-on names."""
    got = options(argv)
    if got.review:
        sections = {}
        for name in ("edges", "findings", "affected-files"):
            rows = spark.read.parquet(f"{got.review}/{name}")
            sections[name] = rows.filter(F.col("depth") <= (got.review_depth or 5)) if "depth" in rows.columns else rows
        text = report.review_report(sections, "current", [], got.review_format or "text")
        if got.review_output:
            with open(got.review_output, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            out.write(text)
        return 0
    found = spark.read.parquet(got.findings)
    new = report.beyond_baseline(found, got.baseline) if got.baseline else found
    counts = {r.finding_type: r.n for r in new.groupBy("finding_type").agg(F.count("*").alias("n")).collect()}
    if got.format == "sarif":
        out.write(report.sarif_document(new) + "\n")
    elif got.format == "json":
        rows = new.limit(10_000).toJSON().collect()
        out.write(json.dumps({"findings": [json.loads(r) for r in rows], "total": sum(counts.values())}, indent=2) + "\n")
    else:
        out.write(f"{found.count()} finding(s), {sum(counts.values())} new versus baseline.\n")
        for r in new.orderBy("finding_type", "title").limit(50).collect():
            out.write(f"- [{r.finding_type}] {r.title}\n")
    if got.write_baseline:
        report.write_baseline(found, got.baseline)
    return int(any(t in counts for t in got.fail_on))


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.getOrCreate(), sys.argv[1:]))
