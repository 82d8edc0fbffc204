import json

import pytest
from pyspark.sql import functions as F

from codeloom import tables
from codeloom.functions import canonical
from codeloom.operators import sections, upkeep
from codeloom.sources import manifests


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_a_table_is_replaced_as_a_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for k in (1, 2):
        upkeep.replace_table(spark.range(k), path)
        assert spark.read.parquet(path).count() == k
    with pytest.raises(Exception):
        upkeep.replace_table(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert spark.read.parquet(path).count() == 2
    assert [p.name for p in tmp_path.iterdir() if "old" in p.name] == []


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        applicationId, master = "other", "spark://host:7077"

    class Session:
        sparkContext, conf = Context, type("C", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError):
        tables.shared_dir(Session)
    assert tables.shared_dir(spark) == tables.shared_dir(spark)


def test_cursors():
    c = sections.encode_cursor(7, "edges", 300)
    assert sections.decode_cursor(c) == (7, "edges", 300) and "=" not in c
    for bad in ("", "a b", c + "A", c[:-2], "e30", sections.encode_cursor(7, "edges", 300).swapcase()):
        with pytest.raises(ValueError):
            sections.decode_cursor(bad)
    with pytest.raises(ValueError):
        sections.encode_cursor(0, "edges", 0)


def test_pages_by_cursor(spark):
    df, cursor, got = spark.range(250).withColumnRenamed("id", "n"), None, []
    while True:
        page, cursor = sections.cursor_page(df, ["n"], 1, "edges", cursor)
        got += [r.n for r in page.collect()]
        if cursor is None:
            break
    assert got == list(range(250))
    with pytest.raises(ValueError):
        sections.cursor_page(df, ["n"], 2, "edges", sections.encode_cursor(1, "edges", 0))


def test_sections_know_their_filters(spark):
    df = spark.createDataFrame([("added", "a/b.ts", 1), ("removed", "ab/c.ts", 3)], "direction string, path string, depth int")
    assert rows(sections.filtered(df, "edges", {"folderPrefix": "a/"}).select("path")) == [("a/b.ts",)]
    assert rows(sections.filtered(df, "affected-files", {"minDepth": 2, "languages": []}).select("path")) == [("ab/c.ts",)]
    for section, bad in (("edges", {"severities": ["high"]}), ("limitations", {"folderPrefix": "a"}), ("edges", {"deltaDirections": ["introduced"]}), ("affected-files", {"minDepth": 3, "maxDepth": 2})):
        with pytest.raises(ValueError):
            sections.filtered(df, section, bad)


def test_one_row_stands_for_a_key(spark):
    schema = "finding_type string, fingerprint string, title string"
    b = spark.createDataFrame([("t", "1", "b"), ("t", "1", "a"), ("t", "2", None)], schema)
    a = spark.createDataFrame([("t", "2", "x"), ("t", "3", "b"), ("t", "3", "a")], schema)
    got = sections.section_delta(b, a, sections.finding_key(), "findings")
    assert rows(got.select("direction", "fingerprint", "title")) == [("introduced", "3", "a"), ("resolved", "1", "a")]
    cycles = spark.createDataFrame([(["b", "a", "b"],), (["a", "b"],)], "member_paths array<string>")
    assert cycles.select(sections.cycle_key()).distinct().count() == 1
    e = spark.createDataFrame([("index.ts", "f", "function", "a.ts")], "entry_point string, exported_name string, symbol_kind string, origin_path string")
    v = spark.createDataFrame([("r", "x", "a", "b")], "rule_id string, rule_fingerprint string, source_path string, target_path string")
    assert all(len(r[0]) == 64 for r in (e.select(sections.export_key()).first(), v.select(sections.violation_key()).first()))


def test_comparable_snapshots(spark):
    side = lambda s, c: spark.createDataFrame([(s, c)], "side string, commit string")
    sections.check_comparable(side("baseline", "x"), side("target", "x"), ["commit"])
    for b, t in ((side("baseline", "x"), side("target", "y")), (side("target", "x"), side("target", "x"))):
        with pytest.raises(ValueError):
            sections.check_comparable(b, t, ["commit"])


def test_canonical_json_and_base64url(spark):
    df = spark.createDataFrame([(None, 1, "ÿ?😀".encode("utf-16", "surrogatepass").decode("utf-16"))], "b string, a int, t string")
    assert df.select(canonical.canonical_json(b="b", a="a")).first()[0] == '{"a":1,"b":null}'
    coded = df.select(canonical.base64url(F.encode("t", "UTF-8")).alias("c"))
    assert not set(coded.first().c) & set("+/=")
    assert coded.select(F.decode(canonical.from_base64url(F.col("c")), "UTF-8")).first()[0] == df.first().t
    assert spark.createDataFrame([("a+b",)], "c string").select(canonical.from_base64url(F.col("c"))).first()[0] is None


def test_statuses(spark):
    zero = "0" * 40
    tokens = [f"1 .M N... 100644 100644 100644 {zero} {zero} src/a b.ts", f"1 A. N... 0 100644 100644 {zero} {zero} new.ts", f"2 R. N... 100644 100644 100644 {zero} {zero} R100 to.ts", "from x.ts", "? note.txt", f"1 .D N... 100644 100644 000000 {zero} {zero} gone.ts", f"u UU N... 1 1 1 1 {zero} {zero} {zero} both.ts", "! skip"]
    got = manifests.status_entries(spark.createDataFrame([("\0".join(tokens) + "\0",)], "value string"))
    assert rows(got.na.fill("")) == sorted([("modified", False, True, "src/a b.ts", ""), ("added", True, False, "new.ts", ""), ("renamed", True, False, "to.ts", "from x.ts"), ("untracked", False, True, "note.txt", ""), ("deleted", False, True, "gone.ts", ""), ("conflicted", True, True, "both.ts", "")], key=repr)


def test_trees(spark):
    lines = [f"100644 blob {'a' * 40}      12\tsrc/A.ts", f"100755 blob {'a' * 40}       5\tsrc/a.ts", f"120000 blob {'b' * 40}       9\tlink", f"160000 commit {'c' * 40}       -\tsub"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert manifests.preflight(manifests.tree_entries(df)).first().asDict() == {"entries": 4, "bytes": 17, "links": 1, "submodules": 1, "collisions": 1, "fits": False}
    with pytest.raises(Exception):
        manifests.tree_entries(df.union(spark.createDataFrame([("100644 blob x\ty",)], "value string"))).count()


def test_renames(spark):
    log = spark.createDataFrame([(1, "abc\n\nR100\ta b\tc\nR90\td\te"), (2, "def\nM\tx")], "n int, value string")
    assert [(r.commit, r.old_path, r.path) for r in manifests.renames(log).collect()] == [("abc", "a b", "c"), ("abc", "d", "e")]


def test_style_sheets(spark):
    css = "/* @import 'no' */ @import 'a.css'; @import url(\"b.css\") screen; .x { background: url('i.png') } .y { src: url(f.woff) }"
    got = manifests.css_references(spark.createDataFrame([(1, css)], "k int, t string"), "k", "t")
    assert rows(got) == [(1, "import", "a.css", 1), (1, "import", "b.css", 1), (1, "url", "f.woff", 1), (1, "url", "i.png", 1)]


def test_language_roots(spark):
    files = [("go.mod", "// x\nmodule example.org/m\n"), ("Cargo.toml", '[package]\nname = "crate"\n'), ("pyproject.toml", 'name = "my-pkg"\n'), ("setup.cfg", "name = 'other'"), ("my_pkg/__init__.py", ""), ("src/my_pkg/__init__.py", ""), ("deep/go.mod", "module no")]
    got = manifests.language_roots(spark.createDataFrame(files, "path string, text string"))
    assert rows(got) == [("go", "example.org/m", ""), ("python", "my_pkg", "src/my_pkg"), ("rust", "crate", "")]


@pytest.mark.parametrize("path, language", [("a/Dockerfile", "dockerfile"), ("Dockerfile.dev", "dockerfile"), ("GNUmakefile", "makefile"), (".gitignore", "plaintext"), ("x.TSX", "typescript"), ("a.b/c", "plaintext"), ("a\\b.rs", "rust"), (".env", "ini")])
def test_languages(spark, path, language):
    assert spark.createDataFrame([(path,)], "p string").select(manifests.language_of(F.col("p"))).first()[0] == language


def test_configs(spark):
    text = '{ // note\n "compilerOptions": { "baseUrl": "./src", /* x */ "paths": { "@/*": ["lib/*", "../up/*"], "http://x": ["y"], }, }, }'
    df = spark.createDataFrame([("tsconfig.json", text), ("jsconfig.json", "{}"), ("app/jsconfig.json", "{}"), ("a/b/c/d/tsconfig.json", "{}"), ("bad/tsconfig.json", "{"), ("tsconfig.base.json", "{}")], "path string, text string")
    used = manifests.nearest_configs(df)
    assert [r.config_path for r in used.collect()] == ["app/jsconfig.json", "bad/tsconfig.json", "tsconfig.json"]
    facts = {r.config_path: r for r in manifests.config_facts(used).collect()}
    assert facts["tsconfig.json"].base_url == "src" and facts["bad/tsconfig.json"].aliases is None
    assert {a.pattern: a.targets for a in facts["tsconfig.json"].aliases} == {"@/*": ["src/lib/*", "src/../up/*"], "http://x": ["src/y"]}


def test_package_names(spark):
    df = spark.createDataFrame([(json.dumps({"name": "a"}),), (json.dumps({"name": 7}),), ("{",), (None,)], "text string")
    assert rows(manifests.package_names(df)) == [("a",)]
