"""Digests of trees and sets, inherited configs, line ranges, published tables and tables in buckets."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from codeloom.operators import digests, ranges, upkeep
from codeloom.sources import manifests
from codeloom.streaming import changes


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_set_digest_is_of_the_set(spark):
    frame = spark.createDataFrame([("a", str(k)) for k in range(50)], "g string, m string")
    one = digests.member_sets(frame.repartition(5), "g", "m").first()
    assert one == digests.member_sets(frame.orderBy(F.desc("m")), "g", "m").first() and one.members == 50 and one["first"] == "0"
    others = [digests.member_sets(x, "g", "m").first().identity for x in (frame.filter("m <> '7'"), frame.union(frame.limit(1)), frame.withColumn("m", F.when(F.col("m") == "7", "x").otherwise(F.col("m"))))]
    assert len({one.identity, *others}) == 4


def tree(spark, files):
    return digests.folder_digests(spark.createDataFrame([(p, F_sha(c)) for p, c in files.items()], "path string, digest string"))


def F_sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_folder_digests_tell_where_trees_differ(spark):
    files = {"a/b/x.ts": "1", "a/b/y.ts": "2", "a/c/d/e/z.ts": "3", "top.ts": "4", "q/b/x.ts": "1", "q/b/y.ts": "2"}
    base = tree(spark, files)
    by = {r.folder: (r.digest, r.files) for r in base.collect()}
    assert set(by) == {"", "a", "a/b", "a/c", "a/c/d", "a/c/d/e", "q", "q/b"} and by[""][1] == 6 and by["a"][1] == 3
    assert by["a/b"][0] == by["q/b"][0] != by["a"][0]
    assert rows(digests.changed_folders(base, tree(spark, files | {"a/c/d/e/z.ts": "5"}))) == [(f, "changed") for f in ("", "a", "a/c", "a/c/d", "a/c/d/e")]
    moved = {k: v for k, v in files.items() if not k.startswith("q/")} | {"r/x.ts": "1"}
    assert rows(digests.changed_folders(base, tree(spark, moved))) == sorted([("", "changed"), ("q", "removed"), ("q/b", "removed"), ("r", "added")], key=repr)
    assert digests.folder_digests(spark.createDataFrame([], "path string, digest string")).count() == 0


def test_configs_inherit(spark):
    options = lambda **o: {"compilerOptions": o}
    texts = {
        "tsconfig.json": {"extends": "./base/root.json", **options(baseUrl="src")},
        "base/root.json": {"extends": "./deep", **options(paths={"@/*": ["./*"]})},
        "base/deep.json": options(baseUrl="..", paths={"far": ["far"]}),
        "app/tsconfig.json": {"extends": ["../base/deep.json", "../app/other.json"]},
        "app/other.json": options(paths={"o": ["./own", "../up"]}),
        "lib/tsconfig.json": {"extends": "@scope/config"},
        "self/tsconfig.json": {"extends": "./tsconfig.json", **options(baseUrl=".")},
        "plain/tsconfig.json": {},
    }
    frame = spark.createDataFrame([(p, json.dumps(t)) for p, t in texts.items()] + [("bad/tsconfig.json", "no json"), ("null/tsconfig.json", None)], "path string, text string")
    got = {r.config_path: (r.base_url, {a.pattern: a.targets for a in r.aliases or []}, r.chain, r.problem) for r in manifests.inherited_facts(frame).collect()}
    assert got["tsconfig.json"] == ("src", {"@/*": ["src/*"]}, ["tsconfig.json", "base/root.json", "base/deep.json"], None)
    assert got["app/tsconfig.json"] == ("", {"o": ["own", "../up"]}, ["app/tsconfig.json", "app/other.json", "base/deep.json"], None)
    assert got["app/other.json"][:2] == (None, {"o": ["app/own", "up"]})
    assert got["lib/tsconfig.json"] == (None, {}, ["lib/tsconfig.json"], "missing")
    assert got["self/tsconfig.json"] == ("self", {}, ["self/tsconfig.json"], "cycle")
    assert got["plain/tsconfig.json"] == got["bad/tsconfig.json"][:2] + (["plain/tsconfig.json"], None) == (None, {}, ["plain/tsconfig.json"], None)
    assert len(got) == 10
    used = spark.createDataFrame([("app/tsconfig.json",)], "config_path string")
    assert [r.config_path for r in manifests.inherited_facts(frame, used).collect()] == ["app/tsconfig.json"]


def test_points_meet_ranges_of_any_length(spark):
    rnd = random.Random(6)
    spans = [(rnd.randrange(3), a, a + rnd.choice([0, 0, 1, 5, 63, 64, 1000, 100_000]), k) for k in range(120) for a in [rnd.randrange(2000)]] + [(0, 9, 3, 999), (None, 1, 5, 998)]
    points = [(k, rnd.choice([0, 1, 2, 3, None]), rnd.choice([rnd.randrange(3000), None])) for k in range(300)]
    got = ranges.in_ranges(spark.createDataFrame(points, "id long, f long, line long").repartition(3), spark.createDataFrame(spans, "f long, lo long, hi long, commit long"), "f", "line", "lo", "hi")
    want = []
    for k, f, line in points:
        hits = [(lo, hi, c) for g, lo, hi, c in spans if f is not None and g == f and line is not None and lo <= line <= hi]
        want += [(f, k, line, *h) for h in hits or [(None, None, None)]]
    assert rows(got.select("f", "id", "line", "lo", "hi", "commit")) == sorted(want, key=repr)
    none = ranges.in_ranges(spark.createDataFrame(points[:2], "id long, f long, line long"), spark.createDataFrame([], "f long, lo long, hi long, commit long"), "f", "line", "lo", "hi")
    assert none.count() == 2 and none.filter("commit IS NOT NULL").count() == 0


def test_readers_never_miss_a_published_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert upkeep.published(spark, path) is None
    upkeep.publish(spark.range(3).coalesce(1), path)
    seen, failed, stop = [], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.append(upkeep.published(spark, path).agg(F.count("*"), F.max("id")).first())
            except Exception as e:
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(4, 54):
        upkeep.publish(spark.range(k).coalesce(1), path)
    stop.set()
    reader.join()
    assert not failed and seen and all(n == top + 1 for n, top in seen) and [n for n, _ in seen] == sorted(n for n, _ in seen)
    with pytest.raises(Exception):
        upkeep.publish(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert upkeep.published(spark, path).count() == 53
    upkeep.publish(spark.range(1), path, keep_seconds=-1)
    assert [n for n in os.listdir(tmp_path / "t") if not n.startswith(("_", "."))] == sorted(n for n in os.listdir(tmp_path / "t/_published") if not n.startswith("."))[-1:]
    assert upkeep.published(spark, path).count() == 1


def files_of(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "k long, at long, v string"
    assert upkeep.merge_buckets(spark.createDataFrame([(k, 1, f"v{k}") for k in range(400)], schema), path, ["k"], "at", 16) == 16
    before = files_of(path)
    batch = spark.createDataFrame([(7, 2, "new"), (7, 3, "newest"), (8, 0, "stale"), (1000, 1, "more")], schema)
    touched = upkeep.merge_buckets(batch, path, ["k"], "at", 16)
    after = files_of(path)
    assert 0 < touched <= 3 and len(before - after) == touched == len(after - before)
    table = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert len(table) == 401 and table[7] == "newest" and table[8] == "v8" and table[1000] == "more"
    upkeep.merge_buckets(batch, path, ["k"], "at", 16)
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == table
    assert upkeep.merge_buckets(batch.limit(0), path, ["k"], "at", 16) == 0


def test_a_watched_folder_keeps_buckets(spark, tmp_path):
    for d in ("in", "out"):
        os.mkdir(tmp_path / d)
    notes = [{"path": p, "change": c, "at": f"2024-01-01T00:00:0{k}"} for k, (p, c) in enumerate([("src/a.ts", "add"), ("node_modules/x/b.ts", "add"), ("src/a.ts", "change"), ("dist.ts", "add"), ("src/dist/c.ts", "add")])]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, notes)))
    stream = changes.watched(spark, str(tmp_path / "in"), ["node_modules", "dist"])
    changes.keep_buckets(stream, f"{tmp_path}/out/t", ["path"], "at", f"{tmp_path}/out/c", 4).trigger(availableNow=True).start().awaitTermination(60)
    assert rows(spark.read.parquet(f"{tmp_path}/out/t").select("path", "change")) == [("dist.ts", "add"), ("src/a.ts", "change")]


def test_json_verdicts(spark):
    texts = {"a": '{"x": "// no, }"}', "b": '{"x": [1, 2,], /* c */ }', "c": '{"x": 1', "d": " \n", "e": None, "f": "[1] // end", "g": '{"x": "/* ", }', "h": "{'x': 1}", "i": "3", "j": "1, 2", "k": '1, "b": 2', "l": "1] , [2", "m": "{} x"}
    got = dict(map(tuple, manifests.json_verdicts(spark.createDataFrame(list(texts.items()), "path string, text string"), "path").collect()))
    assert got == {"a": "valid", "b": "tolerant", "c": "broken", "d": "empty", "e": "empty", "f": "tolerant", "g": "tolerant", "h": "broken", "i": "valid", "j": "broken", "k": "broken", "l": "broken", "m": "broken"}
