import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import ids, lines, patterns
from codeloom.operators import findings, graph, metrics, review, rules, textops


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def test_shortest_path_is_the_first_of_equals(spark):
    e = edges(spark, (1, 3), (1, 2), (2, 4), (3, 4), (4, 5))
    found, cut = graph.shortest_paths(e, spark.createDataFrame([(1,)], "node long"), 2)
    assert rows(found.select("node", "depth", F.array_join(F.col("path").cast("array<string>"), ">"))) == [(1, 0, "1"), (2, 1, "1>2"), (3, 1, "1>3"), (4, 2, "1>2>4")]
    assert cut.first().truncated
    assert not graph.shortest_paths(e, spark.createDataFrame([(1,)], "node long"), 3)[1].first().truncated


@pytest.mark.parametrize(
    "pairs, expected",
    [
        ([(1, 2), (2, 3)], []),
        ([(1, 2), (2, 1)], [(1, 1), (2, 1)]),
        ([(1, 1)], []),
        ([(1, 1), (1, 2), (2, 1)], [(1, 1), (2, 1)]),
        ([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)], [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]),
    ],
)
@pytest.mark.parametrize("task_edges", [500_000, 0])
def test_strong_components(spark, monkeypatch, pairs, expected, task_edges):
    monkeypatch.setattr(graph, "TASK_EDGES", task_edges)
    for seed in range(2):
        random.Random(seed).shuffle(pairs)
        assert rows(graph.strong_components(edges(spark, *pairs))) == expected


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 500)
    made, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: made.append(name) or real(df, name))
    n = 20_000
    e = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).union(edges(spark, (n - 1, 5000), (7000, 6000)))
    found = graph.strong_components(e.repartition(4))
    assert tuple(found.agg(F.count("*"), F.min("node"), F.max("node"), F.count_distinct("component"), F.min("component")).first()) == (n - 5000, 5000, n - 1, 1, 5000)
    assert len(made) < 100


def test_representative_cycles(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 1), (2, 1), (5, 6), (6, 7), (7, 5), (3, 5))
    found = graph.representative_cycle(e, graph.strong_components(e))
    assert sorted((r.component, r.length, r.path) for r in found.collect()) == [(1, 2, [1, 2, 1]), (5, 3, [5, 6, 7, 5])]


@pytest.mark.parametrize("task_edges", [500_000, 0])
def test_strong_components_and_reach_on_random_graphs(spark, monkeypatch, task_edges):
    monkeypatch.setattr(graph, "TASK_EDGES", task_edges)
    monkeypatch.setattr(graph, "BLOCK_BITS", 64)
    rnd = random.Random(7)
    pairs = {(rnd.randrange(30), rnd.randrange(30)) for _ in range(45)}
    reach = {a: {b for x, b in pairs if x == a} for a in range(30)}
    for _ in range(30):
        for a in reach:
            reach[a] = reach[a].union(*(reach[b] for b in reach[a]))
    parts = {(a, min(b for b in reach[a] | {a} if a in reach[b] or a == b)) for a in reach if any(a in reach[b] and b != a for b in reach[a])}
    e = edges(spark, *pairs)
    assert rows(graph.strong_components(e)) == sorted(parts)
    nodes = {x for p in pairs for x in p}
    assert rows(graph.reach_counts(e.filter("src <> dst"))) == sorted((a, len(reach[a] - {a})) for a in {x for p in pairs if p[0] != p[1] for x in p})
    assert {r.node for r in graph.reachable(e, spark.createDataFrame([(0,)], "node long")).collect()} == reach[0] | {0}
    assert nodes


def test_graphs_without_edges(spark):
    e = spark.createDataFrame([], "src long, dst long")
    assert graph.strong_components(e).count() == graph.reach_counts(e).count() == 0
    assert rows(graph.shortest_paths(e, spark.createDataFrame([(1,)], "node long"), 3)[0].select("node")) == [(1,)]


@pytest.mark.parametrize(
    "glob, path, hit",
    [("src/**", "src/a/b.ts", True), ("src/*", "src/a/b.ts", False), ("**/*.ts", "a.ts", True), ("**/*.ts", "x/a.ts", True), ("a?.ts", "ab.ts", True), ("a?.ts", "a/.ts", False), ("{a,b}/*.ts", "b/x.ts", True), ("a.ts", "aXts", False), ("A.ts", "a.ts", False)],
)
def test_globs(spark, glob, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(F.col("p").rlike(patterns.glob_regex(glob))).first()[0] is hit


@pytest.mark.parametrize("glob", ["", "a{b", "a}b"])
def test_bad_globs(glob):
    with pytest.raises(ValueError):
        patterns.glob_regex(glob)


def test_ignore_rules_last_match_wins(spark):
    r = patterns.ignore_rules("# note\n*.log\nbuild/\n/top.txt\n!keep.log\n")
    paths = ["a.log", "x/keep.log", "build/x", "x/build/y", "top.txt", "x/top.txt", "src/a.ts"]
    found = spark.createDataFrame([(p,) for p in paths], "p string").filter(patterns.ignored(F.col("p"), r))
    assert {x.p for x in found.collect()} == {"a.log", "build/x", "x/build/y", "top.txt"}


def test_node_addresses(spark):
    df = spark.createDataFrame([("file:a/b.ts",), ("symbol:a/b#c.ts#f",), ("folder:a",), ("file:",), ("symbol:x",), ("other:x",)], "n string")
    assert [tuple(r) for r in df.select(ids.node_kind(F.col("n")), ids.owning_path(F.col("n"))).collect()] == [("file", "a/b.ts"), ("symbol", "a/b#c.ts"), ("folder", "a"), (None, None), (None, None), (None, None)]


def test_folders(spark):
    df = spark.createDataFrame([("a/b/c/d.ts",), ("a/d.ts",), ("d.ts",)], "p string")
    assert [r[0] for r in df.select(ids.folder_of(F.col("p"))).collect()] == ["a/b", "a", "."]
    assert [r[0] for r in df.select(ids.ancestors(F.col("p"))).collect()] == [["a", "a/b", "a/b/c"], ["a"], []]


def test_conflicts_machine(spark):
    text = "\n".join(["<<<<<<< one", "=======", "<<<<<<< two", ">>>>>>> x", "=======", ">>>>>>> y", "<<<<<<< three"])
    df = lines.lines_of(spark.createDataFrame([(1, text)], "k int, text string"), "k")
    assert rows(lines.merge_conflicts(df, "k").na.fill(-1)) == [(1, 1, -1, False, "one"), (1, 3, 4, False, "two"), (1, 7, -1, False, "three")]


def test_percentile_of_a_single_score(spark):
    assert metrics.with_percentiles(spark.createDataFrame([(1, 7)], "node int, score int")).first().percentile == 50


def test_clones_count_windows_not_files(spark):
    block = "\n".join(f"line {i}" for i in range(6))
    df = spark.createDataFrame([(1, block + "\nx\n" + block), (2, "  \n" + block.replace("line", "  line  "))], "k long, text string")
    assert [(r.occurrences, r.files, r.first_file, r.first_line) for r in textops.clone_groups(df, "k").collect()] == [(3, 2, 1, 1)]


def test_retention_reports_what_it_cut(spark):
    delta = spark.range(2005).select(F.col("id").alias("k"), F.lit("added").alias("direction"))
    kept, told = findings.retained(delta.repartition(7), ["k"])
    assert kept.count() == 2000 and kept.agg(F.max("k")).first()[0] == 1999 and tuple(told.first()) == (2005, 2000, True)


def test_fingerprint_compare(spark):
    f = lambda *x: spark.createDataFrame([(v,) for v in x], "fingerprint string")
    assert tuple(findings.fingerprint_changes(f("a", "b"), f("b", "c")).first()) == (1, 1, 1)
    with pytest.raises(ValueError):
        findings.page(f("a"), ["fingerprint"], 0, 501)


def test_two_sided_impact(spark):
    both = edges(spark, (2, 1), (3, 2)).withColumn("side", F.lit("baseline")).union(edges(spark, (2, 1), (4, 1)).withColumn("side", F.lit("target")))
    changed = spark.createDataFrame([(1, None, "modified")], "node long, old_node long, change string")
    found = review.impact(both, changed, 3)
    assert rows(found.select("node", "depth", "sides")) == [(2, 1, "baseline+target"), (3, 2, "baseline"), (4, 1, "target")]
    assert rows(review.evidence(found)) == [(2, 1), (3, 2), (4, 1)]


def test_rules_skip_exceptions_and_unresolved(spark):
    files = spark.createDataFrame([(1, "ui/a.ts"), (2, "db/b.ts"), (3, "ui/a.test.ts")], "id long, path string")
    e = spark.createDataFrame([(1, 2, False, 9), (1, 2, False, 4), (3, 2, False, 1), (2, 1, False, 1), (1, 2, True, 1)], "src long, dst long, unresolved boolean, line int")
    rule = [{"name": "r", "severity": "high", "source": "ui/**", "target": "db/**", "exceptions": ["**/*.test.ts"]}]
    assert rows(rules.violations(e, files, rule)) == [("r", "high", "ui/a.ts", "db/b.ts", 4)]


def test_modularity_of_two_triangles(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 4))
    p = spark.createDataFrame([(n, int(n > 3)) for n in range(1, 7)], "node long, community int")
    assert graph.modularity(e, p).first()[0] == pytest.approx(0.357142857)


def test_unused_exports_and_their_caveats(spark):
    schema = "id long, path string, name string, is_entry boolean, is_re_export boolean, is_default boolean, is_component boolean"
    plain = [False] * 4
    symbols = spark.createDataFrame([(1, "a.ts", "x", *plain), (2, "a.ts", "y", False, False, True, True), (3, "b.ts", "z", *plain), (4, "main.ts", "m", *plain), (5, "e.ts", "e", True, False, False, False), (6, "gen/g.ts", "g", *plain)], schema)
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    used = spark.createDataFrame([(3,)], "id long")
    assert rows(rules.unused_exports(symbols, used, ["gen/**", "a.ts#x"], paths("main.ts"), paths("a.ts"), paths("a.ts", "b.ts"))) == [("a.ts", "y", "barrel,default,component,renamed")]
    assert [r.name for r in rules.unused_exports(symbols, used, []).orderBy("name").collect()] == ["g", "m", "x", "y"]


def test_slices_tell_what_they_leave_out(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 4), (2, 4), (2, 4))
    files = spark.createDataFrame([(1, "a/x.ts"), (2, "a/index.ts"), (3, "ab/z.ts"), (4, "b/w.ts")], "id long, path string")
    kept, told = graph.graph_slice(e, files, cap=2)
    assert rows(kept) == [(2, 3)] and tuple(told.first()) == (4, True)
    assert rows(graph.graph_slice(e, files, folder="a")[0]) == [(1, 2)]
    focus = spark.createDataFrame([(1,)], "node long")
    assert graph.graph_slice(e, files, focus=focus, depth=2)[1].first().nodes == 4 and graph.graph_slice(e, files, focus=focus)[1].first().nodes == 2
    typed = e.withColumn("type_only", F.col("src") == 3)
    assert rows(graph.viewed(typed, files).select("src", "dst")) == [] and len(rows(graph.viewed(typed, files, hide_barrels=False))) == 4


def test_origins_of_exports(spark):
    from codeloom.operators import surface

    symbols = spark.createDataFrame([("a", "one"), ("b", "one"), ("b", "two"), ("c", "default"), ("c", "three"), ("d", "one")], "module string, name string")
    links = spark.createDataFrame([("m", "a", None, None), ("m", "b", None, None), ("m", "c", None, None), ("m", "c", "main", "default"), ("a", "m", None, None), ("d", "a", None, None), ("m", "gone", None, None)], "module string, target string, name string, imported string")
    got = surface.reachable_exports(spark.createDataFrame([("m",), ("d",)], "module string"), symbols, links)
    assert rows(got.na.fill("")) == [("d", "main", "c", "default", False), ("d", "one", "d", "one", False), ("d", "three", "c", "three", False), ("d", "two", "b", "two", False), ("m", "main", "c", "default", False), ("m", "one", "", "", True), ("m", "three", "c", "three", False), ("m", "two", "b", "two", False)]
    assert rows(surface.unresolved_links(links, symbols.select("module").union(links.select("module"))).select("target")) == [("gone",)]


def test_named_entries_or_those_without_edges(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, path string")
    edges = spark.createDataFrame([(1, 2), (2, 2)], "src long, dst long")
    named = lambda *paths: sorted(map(tuple, rules.entry_points(files, spark.createDataFrame([(p,) for p in paths], "path string"), edges).collect()))
    assert named("b", "b", "lost") == [(2, False)]
    assert named("lost", None) == named() == [(1, True), (3, True)]


def test_examples_and_how_many_are_left(spark):
    rows = spark.createDataFrame([("f", x) for x in "dacb"] + [("g", "z"), ("g", None)], "folder string, path string")
    assert sorted(map(tuple, metrics.examples(rows, "folder", "path").collect())) == [("f", 4, ["a", "b", "c"], 1), ("g", 2, ["z"], 0)]


def test_states_of_contents(spark):
    from codeloom.sources import files

    texts = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "é")], "path string, text string")
    known = texts.filter("path <> 'd'").select("path", F.coalesce(F.sha2(F.when(F.col("path") == "b", "old").otherwise(F.col("text")), 256), F.lit("x")).alias("content_hash")).union(spark.createDataFrame([("e", "y")], "path string, content_hash string"))
    assert {r.path: r.state for r in files.content_states(texts, known).collect()} == {"a": "unchanged", "b": "changed", "c": "changed", "d": "new", "e": "gone"}
