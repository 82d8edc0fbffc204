import io
import json

import pytest

from codeloom import cli
from codeloom.operators import report

SCHEMA = "finding_type string, title string, description string, fingerprint string"


def test_findings_against_a_baseline(spark, tmp_path):
    base, table = f"file://{tmp_path}/base", f"file://{tmp_path}/f"
    rows = [("type-error", "one", "d", "1"), ("todo-comment", "two", None, "2")]
    spark.createDataFrame(rows[:1], SCHEMA).write.parquet(table)
    say = lambda *argv: (lambda o: (cli.run(spark, [table, *argv], o), o.getvalue()))(io.StringIO())
    assert say("--baseline", base, "--write-baseline", "--fail-on", "type-error") == (1, "1 finding(s), 1 new versus baseline.\n- [type-error] one\n")
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(table)
    assert say("--baseline", base, "--fail-on", "type-error,merge-conflict") == (0, "2 finding(s), 1 new versus baseline.\n- [todo-comment] two\n")
    assert json.loads(say("--format", "json")[1])["total"] == 2
    document = json.loads(say("--format", "sarif", "--baseline", base)[1])
    assert document["version"] == "2.1.0" and [r["ruleId"] for r in document["runs"][0]["results"]] == ["todo-comment"]
    with pytest.raises(ValueError):
        report.sarif_document(spark.read.parquet(table), limit=1)


@pytest.mark.parametrize("argv", [["--fail-on", "x"], ["--fail-on", ""], ["--format", "xml"], ["--review", "r", "--format", "json"], ["--review-format", "text"], ["--review", "r", "--review-format", "html"], ["--review", "r", "--review-depth", "26"], ["--unknown"], ["--write-baseline"]])
def test_options_are_checked(argv):
    with pytest.raises(SystemExit):
        cli.options(["f", *argv])


def test_reviews(spark, tmp_path):
    for name, df in {"edges": spark.createDataFrame([("a|b", "added")], "path string, direction string"), "findings": spark.createDataFrame([], "path string"), "affected-files": spark.createDataFrame([("x", 1), ("y", 7)], "path string, depth int")}.items():
        df.write.parquet(f"file://{tmp_path}/{name}")
    out = io.StringIO()
    assert cli.run(spark, ["f", "--review", f"file://{tmp_path}"], out) == 0
    assert out.getvalue() == "edges: 1\n  a|b  added\nfindings: 0\naffected-files: 1\n  x  1\n"
    assert cli.run(spark, ["f", "--review", f"file://{tmp_path}", "--review-format", "html", "--review-output", str(tmp_path / "r.html")]) == 0
    assert "<td>a|b</td>" in (tmp_path / "r.html").read_text()
    one = {"edges": spark.read.parquet(f"file://{tmp_path}/edges")}
    assert report.review_report(one, "stale", ["b", "a"], "markdown").startswith("> WARNING: This review is stale (a, b).")
    assert json.loads(report.review_report(one, "current", [], "json"))["sections"][0]["total"] == 1
    with pytest.raises(ValueError):
        report.review_report(one, "incompatible", [], "text")


def test_project_reports(spark):
    tables = {"cycles": spark.range(3), "summary": spark.range(1), "limitations": spark.range(0)}
    got = report.project_report(tables, limit=2)
    assert [(s["title"], len(s["rows"]), s["truncated"]) for s in got] == [("Summary (1)", 1, False), ("Cycles (3)", 2, True), ("Limitations (0)", 0, False)]
    assert [s["title"] for s in report.project_report(tables, ["cycles"])] == ["Cycles (3)"]
    with pytest.raises(ValueError):
        report.project_report(tables, ["none"])


def test_reports_hold_no_machine_paths(spark):
    rows = [("src/a.ts", "see https://x.y/z?q and /home/me/a, C:\\\\x\\\\y", ["../up", "ok"]), (None, "api_key = 12,ok \x1b[31mred\x1b[0m\x07 b", None), ("/abs", "", []), ("c:/x", None, ["a//b", "HTTP://h"]), ("a\\b", "(/x/y) =/z", [" ./x "]), ("secret:1/x", "plain", [""])]
    got = report.sanitised(spark.createDataFrame(rows, "file_path string, note string, memberPaths array<string>")).collect()
    bad = report.NO_PATH
    assert [r.file_path for r in got] == ["src/a.ts", None, bad, bad, "a/b", "[credential removed]"]
    assert [r.memberPaths for r in got] == [[bad, "ok"], None, [], [bad, bad], [bad], [bad]]
    assert [r.note for r in got] == ["see [remote URL removed] and [absolute path removed], [absolute path removed]", "[credential removed],ok red b", "", None, "([absolute path removed]) =[absolute path removed]", "plain"]
