import json
import os
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import linediff, report, resolve
from codeloom.sources import files
from codeloom.streaming import changes


def test_tree_and_classification(spark, tmp_path):
    for name, data in {"src/a.ts": b"x\n", "src/b.bin": b"a\0b", "src/c.txt": b"\xff\xfea\0", "src/d.txt": b"\xef\xbb\xbfhi", "src/bad": b"\xc3(", "node_modules/x.ts": b"x", "src/.nuxt/y.ts": b"y", "src/release/z.ts": b"z"}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.relative_path: (r.status, r.text) for r in files.classified(files.read_tree(spark, f"file://{tmp_path}")).collect()}
    assert got == {"src/a.ts": ("eligible", "x\n"), "src/b.bin": ("binary", None), "src/c.txt": ("eligible", "a"), "src/d.txt": ("eligible", "hi"), "src/bad": ("binary", None), "src/release/z.ts": ("eligible", "z")}


def test_manifests_and_specifiers(spark):
    df = spark.createDataFrame([(json.dumps({"dependencies": {"a": "1"}, "devDependencies": {"@x/b": "2", "a": "1"}}),), ("{",)], "text string")
    assert {r.package for r in files.declared_packages(df).collect()} == {"a", "@x/b"}
    sp = spark.createDataFrame([("@x/b/c",), ("a/d",), ("./e",), ("node:fs",)], "specifier string")
    assert {r.package for r in files.external_packages(sp).collect()} == {"@x/b", "a"}


def test_git_output(spark, tmp_path):
    (tmp_path / "log").write_text("\x1eabcdef1\t86400\n\n3\t1\ta.ts\n-\t-\tb.png\n\x1eabcdef2\t172800\n\n2\t0\ta.ts\n1\t1\tsrc/{old => new}/c.ts\n0\t0\tx.ts => y.ts\n")
    got = sorted((r.commit, r.path, r.additions, r.deletions, r.day.day) for r in files.numstat(files.read_log(spark, f"file://{tmp_path}/log")).collect())
    assert got == [("abcdef1", "a.ts", 3, 1, 2), ("abcdef1", "b.png", 0, 0, 2), ("abcdef2", "a.ts", 2, 0, 3), ("abcdef2", "src/new/c.ts", 1, 1, 3), ("abcdef2", "y.ts", 0, 0, 3)]
    diff = spark.createDataFrame([("M\ta",), ("R096\tb\tc",), ("D\td",)], "value string")
    assert sorted(map(tuple, files.name_status(diff).na.fill("").collect())) == [("deleted", "d", ""), ("modified", "a", ""), ("renamed", "c", "b")]


def targets(spark, paths, imports, **known):
    files_ = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = spark.createDataFrame([i if isinstance(i, tuple) else ("src/m.ts", i) for i in imports], "from_path string, specifier string")
    return {(r.from_path, r.specifier) if r.from_path != "src/m.ts" else r.specifier: (r.target or r.reason) for r in resolve.resolved(rows, files_, **known).collect()}


def test_resolution_order(spark):
    paths = ("src/a.ts", "src/a.js", "src/b/index.ts", "c.ts", "src/x", "src/d.d.ts", "src/d.js", "src/e.d.ts", "src/f.ts", "src/g.tsx", "src/g.jsx", "src/h.js", "src/h.ts", "src/i.mts", "src/k/index.vue", "src/k/index.js", "page.htm", "src/style.less")
    got = targets(spark, paths, ("./a", "./b", "../c", "../../c", "./x", "./none", "lib/y", "zed", "", "./d", "./e", "./f.js", "./g.js", "./g.jsx", "./h.js", "./i.mjs", "./k", "../page", "style.less", "./logo.SVG?url", "/c", "@app/db/x", "~/y", "@app/db", "node:fs"), packages=["lib"])
    assert got == {
        "./a": "src/a.ts", "./b": "src/b/index.ts", "../c": "c.ts", "../../c": "file-not-found", "./x": "src/x", "./none": "file-not-found", "lib/y": "external-package", "zed": "external-package", "": "file-not-found",
        "./d": "src/d.js", "./e": "src/e.d.ts", "./f.js": "src/f.ts", "./g.js": "src/g.tsx", "./g.jsx": "src/g.jsx", "./h.js": "src/h.js", "./i.mjs": "src/i.mts", "./k": "src/k/index.js", "../page": "page.htm", "style.less": "src/style.less",
        "./logo.SVG?url": "non-source-asset", "/c": "c.ts", "@app/db/x": "alias-not-configured", "~/y": "alias-not-configured", "@app/db": "external-package", "node:fs": "external-package",
    }


def test_packages_of_other_languages(spark):
    paths = ("py/pkg/__init__.py", "rs/m/mod.rs", "go/util/b.go", "go/util/util.go", "go/two/z.go", "go/two/a.go", "index.ts")
    got = targets(spark, paths, [("py/x.py", "./pkg"), ("py/x.ts", "./pkg"), ("rs/x.rs", "./m"), ("go/x.go", "./util"), ("go/x.go", "./two"), ("go/x.ts", "./two"), ("x.ts", ".")])
    assert got == {("py/x.py", "./pkg"): "py/pkg/__init__.py", ("py/x.ts", "./pkg"): "file-not-found", ("rs/x.rs", "./m"): "rs/m/mod.rs", ("go/x.go", "./util"): "go/util/util.go", ("go/x.go", "./two"): "go/two/a.go", ("go/x.ts", "./two"): "file-not-found", ("x.ts", "."): "index.ts"}


def test_aliases_of_the_nearest_config(spark):
    configs = spark.createDataFrame(
        [("tsconfig.json", "", None, [("@/*", ["src/../lib/*"]), ("@/deep/*", ["gone/*", "deep/*"]), ("one", ["lib/a.ts"])]), ("app/tsconfig.json", "app", "app/src", [("@/*", ["app/own/*"])]), ("app/jsconfig.json", "app", "app/other", None)],
        "config_path string, folder string, base_url string, aliases array<struct<pattern:string,targets:array<string>>>",
    )
    paths = ("lib/a.ts", "deep/b.ts", "app/own/a.ts", "app/other/c.ts", "app/src/d.ts")
    got = targets(spark, paths, [("x.ts", "@/a"), ("x.ts", "@/deep/b"), ("x.ts", "one"), ("x.ts", "@/none"), ("x.ts", "c"), ("app/z/y.ts", "@/a"), ("app/z/y.ts", "c"), ("app/z/y.ts", "d")], configs=configs)
    assert got == {("x.ts", "@/a"): "lib/a.ts", ("x.ts", "@/deep/b"): "deep/b.ts", ("x.ts", "one"): "lib/a.ts", ("x.ts", "@/none"): "file-not-found", ("x.ts", "c"): "external-package", ("app/z/y.ts", "@/a"): "external-package", ("app/z/y.ts", "c"): "app/other/c.ts", ("app/z/y.ts", "d"): "external-package"}


def test_imports_are_dealt_once_for_their_names(spark):
    files_ = spark.createDataFrame([("src/a.ts",), ("b.ts",)], "path string")
    imports = spark.createDataFrame([("src/m.ts", "./a"), ("src/m.ts", "../b"), ("src/m.ts", "lib")], "from_path string, specifier string")
    plan = resolve.resolved(imports, files_)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1


def test_paths_that_are_cut_are_those_that_are_walked(spark):
    rnd = random.Random(3)
    path = lambda n: "/".join(rnd.choice(["a", "b.c", ".", "..", "..", "", "...", ".h", "..x"]) for _ in range(rnd.randrange(n)))
    pairs = [(path(5), path(6)) for _ in range(3000)] + [(None, "a"), ("a", None), ("a/b", "../../../c"), ("a/b", "../.././c")]
    both = spark.createDataFrame(pairs, "f string, s string").select(resolve.joined(F.col("f"), F.col("s")).alias("x"), resolve._walked(F.concat_ws("/", "f", "s")).alias("y"))
    assert both.filter("NOT x <=> y").isEmpty()


def test_imports_that_occur_twice_and_aliases_with_several_targets(spark):
    configs = spark.createDataFrame([("tsconfig.json", "", None, [("@/*", ["none/*", "lib/*", "src/*"]), ("@/x", ["src/x"])])], "config_path string, folder string, base_url string, aliases array<struct<pattern:string,targets:array<string>>>")
    imports = spark.createDataFrame([(f, s, k) for f in ("m.ts", "src/m.ts") for s in ("@/a", "@/x", "@/no", "./a") for k in range(2)], "from_path string, specifier string, k int")
    files_ = spark.createDataFrame([("lib/a.ts",), ("src/a.ts",), ("lib/x.ts",), ("src/x.ts",)], "path string")
    got = sorted((r.from_path, r.specifier, r.k, r.target or r.reason) for r in resolve.resolved(imports, files_, configs=configs).collect())
    want = {"@/a": "lib/a.ts", "@/x": "src/x.ts", "@/no": "file-not-found"}
    assert got == sorted((f, s, k, want.get(s, "src/a.ts" if f == "src/m.ts" else "file-not-found")) for f in ("m.ts", "src/m.ts") for s in ("@/a", "@/x", "@/no", "./a") for k in range(2))


def test_hunks_turn_old_into_new():
    rnd = random.Random(0)
    for _ in range(500):
        old = [rnd.choice("abc") for _ in range(rnd.randrange(8))]
        new = [rnd.choice("abc") for _ in range(rnd.randrange(8))]
        out, at = [], 0
        for p, n, q, m in linediff.hunks(old, new):
            out += old[at : p - 1]
            assert len(out) == q - 1 and n + m > 0
            out += new[q - 1 : q - 1 + m]
            at = p - 1 + n
        assert out + old[at:] == new
        kept = linediff.kept_lines(old, new)
        best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
        for i, x in enumerate(old):
            for j, y in enumerate(new):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(kept) == best[-1][-1] and all(old[i] == new[j] for i, j in kept)
    assert linediff.hunks(["a"], ["a"]) == [] and linediff.hunks(list("abc"), list("axc")) == [(2, 1, 2, 1)]


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 1), ("c", 2)], "name string, n int").orderBy("n")
    s = [report.section("T", df, 1)]
    assert "a\\|b" in report.markdown(s) and "More rows" in report.markdown(s) and "<td>1</td>" in report.html(s)
    assert json.loads(report.as_json(s))["sections"][0]["truncated"]
    f = spark.createDataFrame([("error", "high", "t", "p", 0, "x")], "finding_type string, severity string, title string, path string, line int, fingerprint string")
    got = json.loads(report.sarif(f).first().value)
    assert got["level"] == "error" and got["locations"][0]["physicalLocation"]["region"]["startLine"] == 1


def test_stream_keeps_the_newest_row(spark, tmp_path):
    schema, source = "k long, v string, t long", str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2)], schema).coalesce(1).write.parquet(source + "/0")
    spark.createDataFrame([(2, "d", 3), (3, "e", 3)], schema).coalesce(1).write.parquet(source + "/1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source + "/*")
    changes.keep_current(stream, str(tmp_path / "out"), ["k"], "t", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.k, r.v) for r in changes.current(spark, str(tmp_path / "out"), 1).collect()) == [(1, "c"), (2, "d"), (3, "e")]


def test_bursts_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate((0, 100, 5000, 5100, 99999))], "user_id long, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, changes.quiet_bursts(rows, "user_id").select("events", "last_event").collect()))
    assert want == [(1, 4), (2, 1), (2, 3)]
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    q = changes.quiet_bursts(stream, "user_id").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("SELECT events, last_event FROM bursts").collect()} <= set(want)
