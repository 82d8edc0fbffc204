"""Graph operators whose tables stay bounded, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom import tables
from codeloom.operators import graph, metrics, sections, surface, textops


def random_graph(seed, n, m):
    rnd = random.Random(seed)
    return sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)})


def below(pairs, x):
    out, seen, work = {}, set(), [x]
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    while work:
        for y in out.get(work.pop(), ()):
            if y not in seen:
                seen.add(y)
                work.append(y)
    return seen


@pytest.mark.parametrize("seed, n, m, beyond", [(1, 40, 60, 3), (2, 60, 75, 5), (3, 25, 160, 4)])
def test_reach_up_to(spark, seed, n, m, beyond):
    pairs = random_graph(seed, n, m) + ([(100 + k, 101 + k) for k in range(12)] + [(200, 300 + k) for k in range(20)] + [(201, 200)] if seed == 1 else [])
    got = {r.node: r.reached for r in graph.reach_up_to(spark.createDataFrame(pairs, "src long, dst long"), beyond).collect()}
    want = {}
    for x in {a for a, b in pairs if a != b}:
        direct = {b for a, b in pairs if a == x and b != x}
        want[x] = len(direct) + min(beyond, len(below(pairs, x) - direct - {x}))
    assert got == want


def test_reach_up_to_without_edges(spark):
    assert graph.reach_up_to(spark.createDataFrame([(1, 1)], "src long, dst long"), 3).count() == 0


def test_tree_paths_hold_edge_types(spark):
    pairs = random_graph(4, 50, 110)
    kinds = ("import", "re-export", "dynamic-import")
    rows = [(a, b, kinds[(a + b + k) % 3]) for a, b in pairs for k in range(2)] + [(60 + k, 61 + k, "import") for k in range(13)]
    tree = graph.search_tree(spark.createDataFrame(rows, "src long, dst long, edge_type string"), spark.createDataFrame([(0,), (60,)], "node long"), 20)
    known = {0: (0, [0], []), 60: (0, [60], [])}
    level = [0, 60]
    while level:
        best = {}
        for a, b, kind in rows:
            if a in level and b not in known:
                best[b] = min(best.get(b, (a, kind)), (a, kind))
        for b, (a, kind) in best.items():
            known[b] = (known[a][0] + 1, known[a][1] + [b], known[a][2] + [kind])
        level = list(best)
    got = {r.node: (r.depth, r.path, r.edge_types) for r in graph.tree_paths(tree, tree).collect()}
    assert got == known and max(d for d, _, _ in known.values()) == 13
    assert {r.node for r in graph.tree_paths(tree, tree.filter("node = 73")).collect()} == {73}


def counted(monkeypatch):
    made = []
    real = tables.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: made.append(name) or real(df, name))
    return made


def test_components_of_a_grid_take_few_tables(spark, monkeypatch):
    """A grid that runs both ways, and one that runs one way and so has no cycle."""
    monkeypatch.setattr(graph, "TASK_EDGES", 200)
    made = counted(monkeypatch)
    side = 30
    cells = spark.range(side * side).select("id", (F.col("id") % side).alias("x"))
    right = cells.filter(F.col("x") < side - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = cells.filter(F.col("id") < side * (side - 1)).select(F.col("id").alias("src"), (F.col("id") + side).alias("dst"))
    one_way = right.union(down)
    both = one_way.union(graph.reversed_edges(one_way)).select((F.col("src") + 10_000).alias("src"), (F.col("dst") + 10_000).alias("dst"))
    got = graph.strong_components(one_way.union(both)).agg(F.count("*"), F.min("component"), F.max("component")).first()
    assert tuple(got) == (side * side, 10_000, 10_000)
    assert len(made) < 100


def test_blocks_of_a_very_long_text(spark):
    """50,000 lines in one text, each block of six twice but where the halves meet."""
    half = 25_000
    text = "\n".join(f"line number {k % half} of the text" for k in range(2 * half))
    docs = spark.createDataFrame([("a", text), ("b", "short"), ("c", None)], "path string, text string")
    got = textops.clone_groups(docs, "path").agg(F.count("*").alias("n"), F.max("occurrences"), F.max("files"), F.min("first_line"), F.max("first_line")).first()
    assert tuple(got) == (half - 5, 2, 1, 1, half - 5)


def test_components_of_a_dense_graph_by_a_few_edges(spark, monkeypatch):
    """Two dense parts with an edge from one to the other, a cycle through both where one leads back, and
    nodes around them."""
    monkeypatch.setattr(graph, "TASK_EDGES", 50)
    made = counted(monkeypatch)
    rnd = random.Random(7)
    dense = {(base + a, base + rnd.randrange(40)) for base in (0, 100) for a in range(40) for _ in range(15)}
    tails = {(200 + k, k) for k in range(10)} | {(100 + k, 300 + k) for k in range(10)} | {(400, 401), (401, 402), (402, 400)}
    for back in (set(), {(105, 7)}):
        pairs = sorted(dense | tails | {(3, 104)} | back)
        got = {r.node: r.component for r in graph.strong_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
        reach = {x: below(pairs, x) for x in {v for p in pairs for v in p}}
        groups = {x: {y for y in reach[x] if x in reach[y]} for x in reach}
        assert got == {x: min(g) for x, g in groups.items() if len(g) > 1}
    assert "scc-inner" in made


def test_tables_between_rounds_are_not_broadcast(spark):
    nodes = graph.stored(spark.range(1000).withColumnRenamed("id", "src"), "plan")
    plan = nodes.join(spark.range(10).withColumnRenamed("id", "src"), "src")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_file_in_a_cycle_longer_than_the_search(spark):
    pairs = [(k, (k + 1) % 5) for k in range(5)] + [(20, 21)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    nothing = spark.createDataFrame([], "node long")
    for file, depth, cyclic, dependents in ((0, 2, True, 2), (0, 25, True, 4), (21, 25, False, 1)):
        row = surface.file_detail(edges, spark.createDataFrame([(file,)], "node long"), nothing, nothing, depth).first()
        assert (row.node, row.in_cycle, row.dependents) == (file, cyclic, dependents)


def test_a_slice_without_a_cap_holds_every_node(spark):
    n = 1600
    files = spark.range(n).select("id", F.concat(F.lit("a/"), F.col("id").cast("string")).alias("path"))
    edges = spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    focus = spark.createDataFrame([(0,)], "node long")
    kept, told = graph.graph_slice(edges, files, "a", focus, 1, cap=None)
    assert kept.count() == n - 1 and tuple(told.first()) == (n, False)


def test_tree_fingerprints_depend_on_the_order_alone(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows_ = [("a", k, k % 7) for k in range(3000)] + [("b", 5, 1), ("b", 2, 9)]
    got = {r.g: r.fingerprint for r in sections.tree_fingerprint(spark.createDataFrame(rows_, "g string, at long, p long").repartition(5), ["g"], ["at"], ["p"]).collect()}
    want = {g: sha("\n".join(sha(f'{{"p":{p}}}') for _, at, p in sorted(r for r in rows_ if r[0] == g))) for g in ("a", "b")}
    assert got == want


def kept(monkeypatch):
    made = []
    real = tables.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: made.append((name, real(df, name))) or made[-1][1].hint("merge"))
    return made


def test_reach_of_a_dense_graph_is_not_followed_to_the_end(spark, monkeypatch):
    made = kept(monkeypatch)
    pairs = random_graph(11, 300, 4000)
    got = {r.node: r.reached for r in graph.reach_up_to(spark.createDataFrame(pairs, "src long, dst long"), 5).collect()}
    direct = {x: {b for a, b in pairs if a == x and b != x} for x in {a for a, b in pairs if a != b}}
    assert got == {x: len(d) + min(5, len(below(pairs, x) - d - {x})) for x, d in direct.items()}
    assert [t.count() for name, t in made if name == "reach-new"] == [0]


def test_labels_of_labels_wait_for_long_ways(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 50)
    made = counted(monkeypatch)
    short = random_graph(12, 60, 400)
    assert graph.strong_components(spark.createDataFrame(short, "src long, dst long")).count() == 60
    assert "labels" in made and "label-hashes" not in made


def test_an_impact_searches_no_level_that_is_not_kept(spark, monkeypatch):
    made = kept(monkeypatch)
    edges = spark.range(2000).select((F.col("id") + 1).alias("src"), (F.col("id") / 10).cast("long").alias("dst")).filter("src <> dst")
    nodes = lambda *x: spark.createDataFrame([(v,) for v in x], "node long")
    got = surface.diff_impact(edges, nodes(0), nodes(3), nodes(15), nodes(), 25, 12)
    rows = sorted((r.depth, r.node, r.is_test, r.is_entry, r.in_cycle) for r in got.collect())
    assert rows == [(1, k, k == 3, False, False) for k in range(1, 11)] + [(2, k, False, False, False) for k in (11, 12)]
    assert len([name for name, _ in made if name == "levels"]) == 3
    assert {r.depth for r in graph.levels(graph.reversed_edges(edges), nodes(0), 25).collect()} == {0, 1, 2, 3, 4}


def test_scores_meet_by_shuffles(spark):
    n = spark.range(100).select(F.col("id").alias("node"))
    counts = lambda name: n.select("node", F.lit(1).cast("long").alias(name))
    out = metrics.impact_scores(n, counts("direct"), counts("reached"), n, n, counts("unresolved"), n)
    assert out.count() == 100 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_two_origins_of_a_name_are_enough(spark, monkeypatch):
    """Thirty modules export one name through a hub to thirty others, which take it from each other too."""
    made = []
    monkeypatch.setattr(surface, "stored", lambda df, name: made.append(tables.stored(df, name)) or made[-1].hint("merge"))
    symbols = spark.createDataFrame([(k, "x") for k in range(30)] + [(7, "y"), (200, "z")], "module long, name string")
    links = [(50, k) for k in range(30)] + [(100 + k, 50) for k in range(30)] + [(100 + k, 100 + (k + 1) % 30) for k in range(30)] + [(50, 200), (200, 100)]
    stars = spark.createDataFrame(links, "module long, target long").selectExpr("*", "null::string AS name", "null::string AS imported")
    got = {(r.entry_point, r.exported_name): (r.origin, r.ambiguous) for r in surface.reachable_exports(spark.createDataFrame([(7,), (50,), (111,), (200,)], "module long"), symbols, stars).collect()}
    shared = {(m, n): v for m in (50, 111, 200) for n, v in (("x", (None, True)), ("y", (7, False)), ("z", (200, False)))}
    assert got == shared | {(7, "x"): (7, False), (7, "y"): (7, False)}
    assert max(t.count() for t in made) <= 30 + 2 + 32 * 3
    every = {(r.module, r.name, r.origin) for r in surface.export_origins(symbols, stars).collect()}
    assert {k: (v.pop(), False) if len(v) == 1 else (None, True) for k in shared for v in [{o for m, n, o in every if (m, n) == k}]} == shared
