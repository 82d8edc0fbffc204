"""Traversal, reach and strong components of directed graphs given as rows src, dst."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from codeloom import tables

#: Edges that one task may search, counted first; some 10 MB.
TASK_EDGES = 20_000
#: Rounds in which labels go along edges alone; labels of labels are taken after so many, where ways are long.
PLAIN_ROUNDS = 12
#: Bits of reached targets that one task holds at a time.
BLOCK_BITS = 1 << 30


def stored(df: DataFrame, name: str) -> DataFrame:
    """tables.stored(), to be met by shuffles: a table of numbers is many times as large in memory as its
    files, by which Spark would choose to send it through the driver to every task."""
    return tables.stored(df, name).hint("merge")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def shortest_paths(edges: DataFrame, roots: DataFrame, max_depth: int, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search, one join a level: node, depth, path (an array from the root).

    roots has a column node. Of a node's shortest paths the one that sorts first is kept, over all
    roots. With by, a column of edges and roots, graphs are searched side by side. The second result
    is a row with truncated, whether an edge leads from the last level to a node that was not seen.
    """
    own = [by] if by else []
    edges = stored(edges.select(*own, "src", "dst"), "bfs-edges")
    seen = stored(roots.select(*own, "node").distinct().select(*own, "node", F.lit(0).alias("depth"), F.array("node").alias("path")), "bfs")
    frontier, truncated = seen, F.lit(False)
    for depth in range(1, max_depth + 2):
        step = frontier.withColumnRenamed("node", "src").join(edges, [*own, "src"]).groupBy(*own, "dst").agg(F.min("path").alias("before"))
        new = step.join(seen.select(*own, F.col("node").alias("dst")).hint("merge"), [*own, "dst"], "left_anti")
        if depth > max_depth:
            truncated = F.lit(not new.isEmpty())
            break
        frontier = stored(new.select(*own, F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.concat("before", F.array("dst")).alias("path")), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen, edges.sparkSession.range(1).select(truncated.alias("truncated"))


def levels(edges: DataFrame, roots: DataFrame, max_depth: int, enough: int | None = None) -> DataFrame:
    """node and depth of what the roots (node) reach within max_depth, breadth first. With enough, no level
    is begun once that many nodes past the roots are known, as all others lie deeper."""
    edges = stored(edges.select("src", "dst"), "level-edges")
    seen = frontier = stored(roots.select("node").distinct().select("node", F.lit(0).alias("depth")), "levels")
    known = 0
    for depth in range(1, max_depth + 1):
        step = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(seen.select("node").hint("merge"), "node", "left_anti").select("node", F.lit(depth).alias("depth")), "levels")
        new = frontier.count()
        known += new
        if not new:
            break
        seen = seen.unionByName(frontier)
        if enough is not None and known >= enough:
            break
    return seen


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Every node that can be reached from a root, the roots among them."""
    edges = stored(edges, "reach-edges")
    seen = frontier = stored(roots.select("node").distinct(), "reach")
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(seen, "node", "left_anti"), "reach")
        seen = stored(seen.unionByName(frontier), "reach-seen")
    return seen


def _labels(edges: DataFrame, turn: int, orders: int = 2) -> DataFrame:
    """node, labels and component of every node of an edge.

    For each of some random orders of all nodes, labels has the least node upstream of a node and the
    least downstream, itself among both, by their hashes. A node takes the least of the labels of those
    neighbours whose labels fell in the round before and, after PLAIN_ROUNDS, of its own label's label, which
    lies the same way; as orders are random, the stretch that is looked through then grows by a factor a
    round, so the rounds are logarithmic in the longest way a label has to go.
    A row holds a node's labels of all orders and both ways, and they are plain numbers, so an edge is one
    row each way and a round aggregates by hash. component is the least node of those with the same label
    both ways, null without any: nodes of one strong component have the same labels.
    """
    pairs = [(k, w) for k in range(orders) for w in (0, 1)]
    name = lambda k, w: f"l{k}{w}"
    nodes = stored(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "label-nodes")
    seed = turn
    hashed = lambda k: F.xxhash64("node", F.lit(k), F.lit(seed))
    whole = isinstance(edges.schema["src"].dataType, LongType)  # the hash of a long has an inverse, so no two are the same
    while not whole and any(not nodes.groupBy(hashed(k)).count().filter("count > 1").isEmpty() for k in range(orders)):
        seed += 1_000_003  # two nodes with one hash: take other hashes
    labels = stored(nodes.select("node", *(hashed(k).alias(name(k, w)) for k, w in pairs), F.lit(True).alias("changed")), "labels")
    own, rounds = None, 0
    while True:
        all_, offers = labels, "g"
        for w, (near, far) in enumerate((("src", "dst"), ("dst", "src"))):
            held = labels.filter("changed").select(F.col("node").alias(near), *(name(k, w) for k in range(orders)))
            given = edges.join(held, near).groupBy(F.col(far).alias("node")).agg(*(F.min(name(k, w)).alias(f"g{k}{w}") for k in range(orders)))
            all_ = all_.join(given.hint("merge"), "node", "left")
        if rounds >= PLAIN_ROUNDS:
            if own is None:
                own = stored(nodes.select("node", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), hashed(k).alias("h")) for k in range(orders)))).alias("o")).select("node", "o.k", "o.h"), "label-hashes")
            each = labels.select("node", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w"), F.col(name(k, w)).alias("h")) for k, w in pairs))).alias("o")).select("node", "o.k", "o.w", "o.h")
            met = each.filter(F.col("h") != F.element_at(F.array(*(hashed(k) for k in range(orders))), F.col("k") + 1)).join(own.withColumnRenamed("node", "at"), ["k", "h"])
            there = labels.select(F.col("node").alias("at"), *(F.col(name(*p)).alias(f"t{p[0]}{p[1]}") for p in pairs))
            leap = met.join(there, "at").groupBy("node").agg(*(F.min(F.when((F.col("k") == k) & (F.col("w") == w), F.col(f"t{k}{w}"))).alias(f"j{k}{w}") for k, w in pairs))
            all_, offers = all_.join(leap.hint("merge"), "node", "left"), "gj"
        best = lambda k, w: F.least(name(k, w), *(f"{o}{k}{w}" for o in offers))  # noqa: B023, E731
        fell = F.lit(False)
        for k, w in pairs:
            fell = fell | (best(k, w) < F.col(name(k, w)))
        labels = stored(all_.select("node", *(best(k, w).alias(name(k, w)) for k, w in pairs), fell.alias("changed")), "labels")
        rounds += 1
        if labels.filter("changed").isEmpty():
            break
    met = F.lit(None).cast("struct<k:int,h:bigint>")
    for k in reversed(range(orders)):
        met = F.when(F.col(name(k, 0)) == F.col(name(k, 1)), F.struct(F.lit(k).alias("k"), F.col(name(k, 0)).alias("h"))).otherwise(met)
    told = labels.select("node", F.array(*(name(*p) for p in pairs)).alias("labels"), met.alias("met")).select("node", "labels", "met.k", "met.h")
    least = told.filter("h IS NOT NULL").groupBy("k", "h").agg(F.min("node").alias("component"))
    return told.join(least, ["k", "h"], "left").select("node", "labels", "component")


def _shortened(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The edges without nodes that no cycle can run through, and with chains made shorter; and the
    nodes v that were taken out of a chain, with their only neighbours p -> v -> w.

    Nodes without an edge in or out go. Of nodes with one edge in and one out those go that have a
    lesser hash than such neighbours, a third of a chain; p -> w takes their place.
    """
    ins = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("n_in"), F.min("src").alias("p"))
    outs = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n_out"), F.min("dst").alias("w"))
    nodes = stored(ins.join(outs.hint("merge"), "v"), "scc-nodes")
    chain = nodes.filter("n_in = 1 AND n_out = 1").select("v", "p", "w", F.xxhash64("v", F.lit(turn)).alias("h"))
    near = lambda end: chain.select(F.col("v").alias(end), F.col("h").alias(f"h_{end}"))
    least = chain.join(near("p"), "p", "left").join(near("w"), "w", "left").filter("(h_p IS NULL OR h < h_p) AND (h_w IS NULL OR h < h_w)")
    taken = stored(least.select("v", "p", "w"), "scc-chain")
    left = nodes.select("v").join(taken, "v", "left_anti")
    kept = edges.join(left.withColumnRenamed("v", "src"), "src", "left_semi").join(left.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst")
    bridges = taken.filter("p <> w").select(F.col("p").alias("src"), F.col("w").alias("dst"))
    return stored(kept.union(bridges).distinct(), "scc-edges"), taken


def _in_one_task(edges: DataFrame) -> DataFrame:
    """node and component of a graph of at most TASK_EDGES edges, by depth-first search."""
    kind = edges.schema["src"].dataType
    schema = StructType([StructField("node", kind), StructField("component", kind)])

    def run(batches):
        out: dict = {}
        for b in batches:
            for x, y in zip(b.column("src").to_pylist(), b.column("dst").to_pylist()):
                out.setdefault(x, []).append(y)
        number, low, stack, on, found = {}, {}, [], set(), []
        for start in out:
            if start in number:
                continue
            work = [(start, iter(out[start]))]
            number[start] = low[start] = len(number)
            stack.append(start)
            on.add(start)
            while work:
                x, rest = work[-1]
                y = next(rest, None)
                if y is None:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[x])
                    if low[x] == number[x]:
                        part = []
                        while not part or part[-1] != x:
                            part.append(stack.pop())
                            on.discard(part[-1])
                        if len(part) > 1:
                            first = min(part)
                            found += [(v, first) for v in part]
                elif y not in number:
                    number[y] = low[y] = len(number)
                    stack.append(y)
                    on.add(y)
                    work.append((y, iter(out.get(y, ()))))
                elif y in on:
                    low[x] = min(low[x], number[y])
        for at in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_pydict({"node": [v for v, _ in found[at : at + 10_000]], "component": [c for _, c in found[at : at + 10_000]]}, schema=to_arrow_schema(schema))

    return edges.select("src", "dst").coalesce(1).mapInArrow(run, schema)


def _few(edges: DataFrame) -> DataFrame:
    """Up to two edges out of each node and two into it, at random."""
    ends = []
    for near, far in (("src", "dst"), ("dst", "src")):
        first = [F.min_by(far, F.xxhash64("src", "dst", F.lit(k))).alias(f"e{k}") for k in (0, 1)]
        picked = edges.groupBy(near).agg(*first).select(near, F.explode(F.array("e0", "e1")).alias(far))
        ends.append(picked.select("src", "dst"))
    return ends[0].union(ends[1]).distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node in a strong component of two nodes or more.

    Where edges are many for each node, the components of a few of them are found first and drawn
    together; what is strongly connected by some edges is so by all. The edges that are left then lead
    between these, and the components of their graph hold theirs.
    """
    left = stored(edges.filter("src <> dst").select("src", "dst").distinct(), "scc-edges")
    layers, size = [], left.count()
    while size > TASK_EDGES:
        few = stored(_few(left), "scc-few")
        if few.count() > size // 2:
            break
        inner = stored(_components(few), "scc-inner")
        layers.append(inner)
        for end in ("src", "dst"):
            left = left.join(inner.select(F.col("node").alias(end), F.col("component").alias("home")), end, "left").withColumn(end, F.coalesce("home", end)).select("src", "dst")
        left = stored(left.filter("src <> dst").distinct(), "scc-edges")
        before, size = size, left.count()
        if size > before // 2:
            break
    found = _components(left)
    for inner in reversed(layers):
        outer = stored(found, "scc")
        moved = inner.join(outer.select(F.col("node").alias("component"), F.col("component").alias("outer")), "component", "left").select("node", F.coalesce("outer", "component").alias("component"))
        found = moved.unionByName(outer.join(inner.select("node"), "node", "left_anti"))
    return found.select("node", "component")


def _components(edges: DataFrame) -> DataFrame:
    """node and component of the strong components of edges without loops and doubles.

    While there are more than TASK_EDGES edges, nodes that no cycle can run through are cut off and
    chains are shortened. Where that no longer helps, each node gets labels: of the nodes upstream and
    of those downstream the least, in several random orders. Nodes whose labels both ways are the same
    node are its component, which leaves; so do edges between nodes of different labels, as those of
    a component agree. What is left, by then a counted number of edges, is searched in one task. Nodes taken
    out of chains then join the component of their neighbours, if both have the same.
    """
    left = edges
    parts, cuts = [], []
    size = left.count()
    while size > TASK_EDGES:
        shorter, taken = _shortened(left, len(cuts))
        cuts.append(taken)
        before, left, size = size, shorter, shorter.count()
        if size <= 0.9 * before or size <= TASK_EDGES:
            continue
        # what a first time left in one piece is split by more orders at once
        labels = stored(_labels(left, len(parts), 4 if parts else 2), "scc-labels")
        parts.append(labels.filter("component IS NOT NULL").select("node", "component"))
        rest = labels.filter("component IS NULL")
        a, b = (rest.select(F.col("node").alias(end), F.col("labels").alias(f"of_{end}")) for end in ("src", "dst"))
        left = stored(left.join(a, "src").join(b, "dst").filter("of_src = of_dst").select("src", "dst"), "scc-edges")
        size = left.count()
    found = _in_one_task(left)
    for members in parts:
        found = found.unionByName(members)
    for taken in reversed(cuts):
        found = stored(found, "scc")
        label = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))  # noqa: B023, E731
        both = taken.join(label("p"), "p", "left").join(label("w"), "w", "left").withColumn("component", F.coalesce("c_p", "p"))
        inside = both.filter(F.col("component") == F.coalesce("c_w", "w"))
        found = found.union(inside.select("v", "component")).union(inside.filter("c_p IS NULL").select("p", "component")).distinct()
    sizes = found.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1").hint("merge")
    return found.join(sizes, "component").select("node", F.col("least").alias("component"))


def _counts_below(dag: DataFrame, sizes: DataFrame) -> DataFrame:
    """home and below, the sizes of all that it reaches, of a graph of at most TASK_EDGES edges without
    a cycle. Sets are bits; tasks take one block of target nodes each, which bounds their memory."""
    spark, kind = dag.sparkSession, dag.schema["x"].dataType
    ends = dag.select(F.col("x").alias("home")).union(dag.select("y")).distinct()
    table, weights = dag.select("x", "y").toArrow(), sizes.join(ends, "home", "left_semi").toArrow()  # at most TASK_EDGES rows, and twice that
    names = weights.column("home").to_pylist()
    place = {h: i for i, h in enumerate(names)}
    bits = np.cumsum([0, *weights.column("size").to_pylist()])
    below: list[list[int]] = [[] for _ in names]
    for x, y in zip(table.column("x").to_pylist(), table.column("y").to_pylist()):
        below[place[x]].append(place[y])
    above = [0] * len(names)
    for ys in below:
        for y in ys:
            above[y] += 1
    order = [i for i, n in enumerate(above) if n == 0]
    for i in order:
        for y in below[i]:
            above[y] -= 1
            if above[y] == 0:
                order.append(y)
    width = max(64, BLOCK_BITS // max(1, len(names)))
    shared = spark.sparkContext.broadcast((names, bits, below, order))
    schema = StructType([StructField("home", kind), StructField("below", LongType())])

    def run(batches):
        names, bits, below, order = shared.value
        for b in batches:
            for block in b.column("id").to_pylist():
                lo, hi = block * width, (block + 1) * width
                own = [(1 << int(min(e, hi) - lo)) - (1 << int(max(s, lo) - lo)) if s < hi and e > lo else 0 for s, e in zip(bits[:-1], bits[1:])]
                sets = [0] * len(names)
                for i in reversed(order):
                    for y in below[i]:
                        sets[i] |= sets[y] | own[y]
                yield pa.RecordBatch.from_pydict({"home": names, "below": [x.bit_count() for x in sets]}, schema=to_arrow_schema(schema))

    blocks = -(-int(bits[-1]) // width)
    return spark.range(0, max(1, blocks), 1, max(1, min(blocks, 1000))).mapInArrow(run, schema).groupBy("home").agg(F.sum("below").alias("below"))


def reach_counts(edges: DataFrame) -> DataFrame:
    """node and reached, how many other nodes it reaches, for every node of an edge.

    Strong components are drawn together first. Of the graph between them, which has no cycle, the
    closure is counted in blocks of targets where it has at most TASK_EDGES edges; beyond that it is
    made level by level.
    """
    edges = stored(edges.select("src", "dst"), "reach-edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    parts = strong_components(edges)
    home = stored(nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("home")), "homes")
    sizes = stored(home.groupBy("home").agg(F.count("*").alias("size")), "home-sizes")
    a, b = home.select(F.col("node").alias("src"), F.col("home").alias("x")), home.select(F.col("node").alias("dst"), F.col("home").alias("y"))
    dag = stored(edges.join(a, "src").join(b, "dst").filter("x <> y").select("x", "y").distinct(), "dag")
    if dag.count() <= TASK_EDGES:
        below = _counts_below(dag, sizes)
    else:
        closure = new = dag
        while not new.isEmpty():
            step = new.join(dag.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", F.col("z").alias("y")).distinct()
            new = stored(step.join(closure, ["x", "y"], "left_anti"), "closure")
            closure = closure.unionByName(new)
        below = closure.join(sizes.withColumnRenamed("home", "y"), "y").groupBy(F.col("x").alias("home")).agg(F.sum("size").alias("below"))
    counts = sizes.join(below, "home", "left").select("home", (F.col("size") - 1 + F.coalesce("below", F.lit(0))).alias("reached"))
    return home.join(counts, "home").select("node", "reached")


def _enough(ways: DataFrame, plain: DataFrame, direct: DataFrame, beyond: int) -> DataFrame:
    """home of those whose neighbours with most edges lead to beyond nodes past all neighbours. ways: home,
    node, n_node and n_home. A home has some 2 * beyond followed edges, and its richest neighbour's and its own."""
    most = Window.partitionBy("home").orderBy(F.desc("n_node"), "node")
    before = F.sum("n_node").over(most.rowsBetween(Window.unboundedPreceding, -1))
    poor = ways.filter(F.col("n_node") <= F.col("n_home") + beyond).withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < 3 * beyond // 2)
    led = poor.select("home", F.col("node").alias("src")).join(plain, "src").select("home", F.col("dst").alias("node")).filter("home <> node")
    past = led.withColumn("own", F.lit(False)).union(direct.select("home", "node", F.lit(True))).groupBy("home", "node").agg(F.bool_or("own").alias("own"))
    return past.groupBy("home").agg(F.count_if(~F.col("own")).alias("n")).filter(F.col("n") >= beyond).select("home")


def reach_up_to(edges: DataFrame, beyond: int) -> DataFrame:
    """node and reached, for every node with an edge out: how many other nodes it reaches, where of those
    that it has no edge to at most beyond are counted.

    No closure is made. A node with an edge to one that has more than beyond + 1 edges more than itself
    is done at once, as that many of them lead elsewhere. Of others only the neighbours with most edges are
    followed first, as many as lead to some 3 // 2 * beyond nodes, which is enough where edges are many. What is
    left is followed level by level, and is done with as soon as it has reached enough, so a node that is
    followed has seen fewer than beyond nodes past its neighbours; after beyond levels all are done.
    """
    plain = stored(edges.filter("src <> dst").select("src", "dst").distinct(), "reach-edges")
    degree = stored(plain.groupBy("src").agg(F.count("*").alias("n")), "reach-degrees")
    of = degree.select(F.col("src").alias("node"), F.col("n").alias("n_node"))
    home = degree.select(F.col("src").alias("home"), F.col("n").alias("n_home"))
    direct = plain.select(F.col("src").alias("home"), F.col("dst").alias("node"))
    frontier, seen, full = direct, None, None
    for _ in range(beyond + 1):
        ways = frontier.join(of, "node").join(home, "home")
        rich = ways.filter(F.col("n_node") > F.col("n_home") + beyond).select("home").distinct()
        full = stored(rich.union(_enough(ways, plain, direct, beyond)).distinct() if full is None else full.union(rich).distinct(), "reach-full")
        step = ways.join(full, "home", "left_anti").select("home", F.col("node").alias("src")).join(plain, "src").select("home", F.col("dst").alias("node")).filter("home <> node").distinct()
        new = step.join(direct, ["home", "node"], "left_anti")
        frontier = stored(new if seen is None else new.join(seen, ["home", "node"], "left_anti"), "reach-new")
        if frontier.isEmpty():
            break
        seen = frontier if seen is None else seen.unionByName(frontier)
        many = seen.groupBy("home").agg(F.count("*").alias("n")).filter(F.col("n") >= beyond).select("home")
        full = stored(full.union(many).distinct(), "reach-full")
        frontier = frontier.join(full, "home", "left_anti")
        seen = stored(seen.join(full, "home", "left_anti"), "reach-seen")
    counts = direct.limit(0).groupBy("home").agg(F.count("*").alias("more")) if seen is None else seen.groupBy("home").agg(F.count("*").alias("more"))
    told = home.join(counts, "home", "left").join(full.withColumn("full", F.lit(True)), "home", "left")
    return told.select(F.col("home").alias("node"), (F.col("n_home") + F.when(F.col("full"), beyond).otherwise(F.coalesce("more", F.lit(0)))).alias("reached"))


def search_tree(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """node, parent, edge_type and depth of what the roots reach, breadth first. edges: src, dst,
    edge_type. Of the edges that lead to a node from the level before, that with the least (src,
    edge_type) is kept; roots have no parent. A row holds one edge, whatever the depth."""
    plain = stored(edges.select("src", "dst", "edge_type").distinct(), "tree-edges")
    kind = edges.schema["src"].dataType
    tree = frontier = stored(roots.select("node").distinct().select("node", F.lit(None).cast(kind).alias("parent"), F.lit(None).cast("string").alias("edge_type"), F.lit(0).alias("depth")), "tree")
    for depth in range(1, max_depth + 1):
        step = frontier.select(F.col("node").alias("src")).join(plain, "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("src", "edge_type")).alias("e"))
        new = step.join(tree.select("node"), "node", "left_anti").select("node", F.col("e.src").alias("parent"), "e.edge_type", F.lit(depth).alias("depth"))
        frontier = stored(new, "tree")
        if frontier.isEmpty():
            break
        tree = tree.unionByName(frontier)
    return tree


def tree_paths(tree: DataFrame, shown: DataFrame) -> DataFrame:
    """node, depth, origin, path and edge_types of the shown nodes (node) of a search tree.

    Only their ways are rebuilt. Each row holds a stretch of its way and the node where that begins;
    stretches are joined to one another, so their length doubles a round.
    """
    ends = F.col("parent").isNull()
    jump = stored(tree.select("node", F.coalesce("parent", "node").alias("top"), F.array("node").alias("path"), F.when(ends, F.array().cast("array<string>")).otherwise(F.array("edge_type")).alias("types"), F.when(ends, 0).otherwise(1).alias("length"), "depth"), "tree-jumps")
    needed = jump.join(shown.select("node").distinct(), "node", "left_semi")
    deepest = tree.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    reach = 1
    while reach < deepest:
        reach *= 2
        on = jump.select(F.col("node").alias("top"), F.col("top").alias("top2"), F.col("path").alias("path2"), F.col("types").alias("types2"), F.col("length").alias("length2"))
        longer = lambda rows: rows.join(on, "top").select("node", F.col("top2").alias("top"), F.when(F.col("length2") == 0, F.col("path")).otherwise(F.concat("path2", "path")).alias("path"), F.concat("types2", "types").alias("types"), (F.col("length") + F.col("length2")).alias("length"), "depth")  # noqa: B023, E731
        needed = stored(longer(needed), "tree-ways")
        if reach < deepest:
            jump = stored(longer(jump), "tree-jumps")
    path = F.when(F.col("depth") == 0, F.col("path")).otherwise(F.concat(F.array("top"), "path"))
    return needed.select("node", "depth", F.col("top").alias("origin"), path.alias("path"), F.col("types").alias("edge_types"))


def representative_cycle(edges: DataFrame, parts: DataFrame, max_length: int = 10_000) -> DataFrame:
    """component, length and path of a shortest cycle through the least node of each strong component,
    of equals the one that sorts first. parts: node and component of strong_components().

    All components are searched side by side, a join a level within their own edges.
    """
    home = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    inner = stored(edges.join(home("src"), "src").join(home("dst"), "dst").filter("c_src = c_dst").select(F.col("c_src").alias("component"), "src", "dst").distinct(), "cycle-edges")
    seen = frontier = stored(parts.select("component").distinct().select("component", F.col("component").alias("node"), F.array("component").alias("path")), "cycles")
    found = None
    for _ in range(max_length):
        step = frontier.withColumnRenamed("node", "src").join(inner, ["component", "src"]).groupBy("component", "dst").agg(F.min("path").alias("path"))
        closed = stored(step.filter("dst = component").select("component", "path"), "cycles-closed")
        found = closed if found is None else stored(found.unionByName(closed), "cycles-found")
        open_ = step.join(found.select("component"), "component", "left_anti").join(seen.select("component", F.col("node").alias("dst")), ["component", "dst"], "left_anti")
        frontier = stored(open_.select("component", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")), "cycles")
        if frontier.isEmpty():
            break
        seen = stored(seen.select("component", "node").unionByName(frontier.select("component", "node")), "cycles-seen")
    return found.select("component", F.size("path").alias("length"), F.concat("path", F.array("component")).alias("path"))


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row, modularity, of a partition (node, community) of the graph taken as undirected; every
    edge row weighs 1."""
    tagged = edges.join(partition.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(partition.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    inner = tagged.groupBy(F.col("a").alias("community")).agg(F.count_if(F.col("a") == F.col("b")).alias("inside"))
    ends = tagged.select(F.col("a").alias("community")).union(tagged.select("b")).groupBy("community").agg(F.count("*").alias("degree"))
    total = tagged.agg(F.count("*").alias("m"))
    each = ends.join(inner, "community", "left").crossJoin(F.broadcast(total))  # a single row
    gain = F.coalesce("inside", F.lit(0)) / F.col("m") - (F.col("degree") / (2 * F.col("m"))) * (F.col("degree") / (2 * F.col("m")))
    return each.agg(F.coalesce(F.round(F.sum(gain), 9), F.lit(0.0)).alias("modularity"))


def viewed(edges: DataFrame, files: DataFrame, hide_type_only: bool = True, hide_barrels: bool = True) -> DataFrame:
    """The edges of a view: without those for types alone, and without index files and their edges.
    edges: src, dst, type_only; files: id, path."""
    out = edges.filter(~F.col("type_only")) if hide_type_only else edges
    if hide_barrels:
        barrels = files.filter(F.col("path").rlike(r"(^|/)index\.[^/]+$")).select(F.col("id").alias("b"))
        out = out.join(barrels.withColumnRenamed("b", "src"), "src", "left_anti").join(barrels.withColumnRenamed("b", "dst"), "dst", "left_anti")
    return out.select(*edges.columns)


def graph_slice(edges: DataFrame, files: DataFrame, folder: str | None = None, focus: DataFrame | None = None, depth: int = 1, cap: int | None = 1500) -> tuple[DataFrame, DataFrame]:
    """Nodes and the distinct edges between them: of a folder, of what lies within depth of focus nodes
    in either direction, and of those the cap with most edges, ties by node (all, if cap is None); and a
    row of nodes (how many there would be) and truncated. edges: src, dst; files: id, path."""
    from codeloom.functions.ids import under

    plain = stored(edges.select("src", "dst").distinct(), "slice-edges")
    inside = files if folder is None else files.filter(under(F.col("path"), folder))
    nodes = inside.select(F.col("id").alias("node"))
    if focus is not None:
        either = plain.union(reversed_edges(plain)).distinct()
        nodes = nodes.join(shortest_paths(either, focus, depth)[0].select("node").distinct(), "node", "left_semi")
    ends = plain.select(F.col("src").alias("node")).union(plain.select("dst")).groupBy("node").agg(F.count("*").alias("n"))
    ranked = stored(nodes.join(ends, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n")), "slice-nodes")
    top = ranked.select("node") if cap is None else stored(ranked.orderBy(F.desc("n"), "node").limit(cap).select("node"), "slice-top")
    kept = plain.join(top.withColumnRenamed("node", "src"), "src", "left_semi").join(top.withColumnRenamed("node", "dst"), "dst", "left_semi")
    told = ranked.agg(F.count("*").alias("nodes")).withColumn("truncated", F.lit(False) if cap is None else F.col("nodes") > cap)
    return kept.select("src", "dst"), told
