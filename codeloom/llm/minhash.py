"""Near-duplicate documents by SuperMinHash signatures, banding and checks on full shingle sets."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_table, fields, forget_encoders, free_name, mix, slices, stored, texts_of, window_hashes, word_hashes, word_spans
from .components import components

#: Bands of so many rows. Of pairs at a similarity of 0.75 they miss 2 in 100,000, above it fewer.
BANDS, ROWS = 28, 4
#: Signatures of a pair at 0.75 agree in fewer places than this in 1 of 100,000 cases.
AGREE = 63

#: Up to so many nodes' ids are broadcast to fetch their texts.
BROADCAST_NODES = 1_000_000
#: Members of a block, and shingles of their sets, on average.
BLOCK, BLOCK_SHINGLES = 512, 500_000

_SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, sig binary, bands array<long>, text_hash long"
_PAIR = "a long, b long"
_CANDIDATES = "bucket long, lo long, hi long, node long, group long, others array<long>"


def shingles(text: bytes, k: int = 5) -> np.ndarray:
    """The distinct hashed k-word shingles, sorted; of fewer words, the whole sequence is one.

    A-Z are lower-cased; words are [^\\x20\\x09-\\x0D]+.
    """
    low = text.lower()
    starts, ends = word_spans(low)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(low, starts, ends)
    return np.unique(window_hashes(h, k) if len(h) >= k else window_hashes(h, len(h)) + np.uint64(len(h)))


@lru_cache(maxsize=2)
def _places(size: int) -> np.ndarray:
    return np.arange(size)


def super_minhash(elements: np.ndarray, size: int) -> np.ndarray:
    """The SuperMinHash signature (O. Ertl, 2017) of a set of 64-bit hashes.

    Every element visits all places in a random order of its own, the j-th with the value j plus a
    random fraction; a place keeps the least value. The j-th visits of all elements are made
    together. No later visit can win once every place holds a value below j, so that most sets
    need one or two rounds of the size that there are.
    """
    out = np.full(size, np.inf)
    if not len(elements):
        return out
    order = None
    for j in range(size):
        r = mix(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        spot = j + ((r >> np.uint64(40)) * np.uint64(size - j) >> np.uint64(24)).astype(np.int64)
        value = j + (mix(r) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        if j == 0 and size * 3 < len(elements):  # likely the only round: the permutations are not kept
            np.minimum.at(out, spot, value)
            if out.max() < 1:
                break
            out[:] = np.inf
        if order is None:
            order = np.tile(_places(size).astype(np.int16), (len(elements), 1))
            rows = np.arange(len(elements))
        place = order[rows, spot]
        order[rows, spot] = order[:, j]
        np.minimum.at(out, place.astype(np.int64), value)
        if out.max() < j + 1:
            break
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """Set size, two digests of the set, signature, band hashes and a hash of the text of every document."""
    size = BANDS * ROWS

    def run(batches):
        forget_encoders()
        batch_of = arrow_table(_SKETCH)
        seeds = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for b in slices(batches):
            out = []
            for doc, text, h in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")), b.column("text_hash").to_pylist()):
                s = shingles(text)
                if not len(s):
                    out.append((doc, 0, 0, 0, b"", [], h))
                    continue
                sig = mix(super_minhash(s, size).view(np.uint64))
                bands = window_hashes(sig, ROWS)[::ROWS] ^ seeds
                d1, d2 = mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                out.append((doc, len(s), int(d1.view(np.int64)), int(d2.view(np.int64)), (sig & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), mix(bands).view(np.int64), h))
            yield batch_of([list(c) for c in zip(*out)])

    return docs.select(F.col("doc_id").cast("long"), "text", _text_hash().alias("text_hash")).mapInArrow(run, fields(_SKETCH))


def _text_hash() -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _alike(percent: int):
    def run(batches):
        forget_encoders()
        batch_of = arrow_table(_PAIR)
        key, first = None, None
        for b in slices(batches, column="text_b"):
            out = []
            for a, c, x, y in zip(*(b.column(n).to_pylist() for n in ("a", "b", "text_a", "text_b"))):
                if key != x:  # rows of one first text mostly come together
                    key, first = x, shingles(x.encode())
                second = shingles(y.encode())
                both = len(np.intersect1d(first, second, assume_unique=True))
                if 100 * both >= percent * (len(first) + len(second) - both) and both:
                    out.append((a, c))
            if out:
                yield batch_of([list(z) for z in zip(*out)])

    return run


def _agree(batches):
    """Pairs whose signatures agree in AGREE places at least."""
    batch_of = arrow_table(_PAIR)
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u4").reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
        good = (x == y).sum(axis=1) >= AGREE
        if good.any():
            yield batch_of([np.array(b.column(c).to_pylist())[good] for c in ("a", "b")])


class _Links:
    """Checks candidate pairs and keeps the links found."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, percent: int) -> None:
        self.nodes, self.docs, self.percent, self.links, self.texts = nodes, docs, percent, None, None

    def sign(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs a, b, n_a, n_b those whose sizes and signatures allow a link."""
        fit = pairs.filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        fit = fit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        sig = self.nodes.select("node", "sig")
        signed = fit.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
        return signed.mapInArrow(_agree, fields(_PAIR))

    def check(self, pairs: DataFrame) -> None:
        """Compares the full sets of pairs a < b and keeps those that are alike."""
        close = stored(pairs, "close-pairs")
        wanted = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
        if self.texts is None:  # of all that are in any close pair; later pairs bring few others
            self.texts = stored(texts_for(self.docs, wanted), "near-texts")
        else:
            more = stored(wanted.join(self.texts.select("node").distinct(), "node", "left_anti"), "more-nodes")
            if not more.isEmpty():
                self.texts = self.texts.unionByName(stored(texts_for(self.docs, more), "near-texts"))
        t = self.texts
        both = close.join(t.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(t.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        self.add(both.select("a", "b", "text_a", "text_b").mapInArrow(_alike(self.percent), fields(_PAIR)))

    def add(self, links: DataFrame) -> None:
        found = stored(links, "near-links")
        self.links = found if self.links is None else self.links.unionByName(found)

    def groups(self) -> DataFrame:
        return components(self.links.select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_duplicates(docs: DataFrame, percent: int = 75, star_rounds: int = 3) -> DataFrame:
    """Groups documents whose 5-word shingle sets have a Jaccard similarity of percent or more.

    Returns doc_id, n_shingles, component_id (the least doc_id reachable by links) and kept (doc_id
    is component_id).

    Documents with the same set are one node. Nodes that share a band are candidates, and a pair is
    linked when its full sets pass. A bucket's pairs are not all made: in each star round, every
    member meets one random member of the bucket, another one in each bucket and round, and buckets
    whose members are all in one group by then are done. What is left in more than one group is
    compared across groups by signatures, block by block, after leaving out nodes that so many
    shingles set apart from all other nodes left that no link is possible; so no link between
    candidates is lost. Sets are of 64-bit hashes of shingles.

    Null or empty texts have no shingles and no links. Rows with a null doc_id are in no group and
    kept. Rows of one doc_id count as one document with the links of all of them. An empty table
    gives no rows. Other columns are ignored.
    """
    return _judged(docs, percent, star_rounds).drop("text_hash")


def _judged(docs: DataFrame, percent: int, star_rounds: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sketched = stored(sketch(texts), "sketches")
    full = sketched.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # stored sides let Spark split a join where one of the other side's keys has very many rows
    classes = stored(full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("node")), "classes")
    ours = classes.withColumnRenamed("node", "doc_id")
    nodes = stored(full.join(ours, ["n_shingles", "d1", "d2", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sig", "bands").dropDuplicates(["node", "sig"]), "nodes")
    rows = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = stored(rows.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "bucket-sizes")
    members = stored(rows.join(sizes, "bucket"), "bucket-members")
    links = _Links(nodes.select("node", "sig"), texts, percent)
    live = members.withColumn("group", F.col("node"))
    for k in range(star_rounds):
        centre = live.groupBy("bucket").agg(F.min_by(F.struct(F.col("node").alias("c"), F.col("n").alias("n_c"), F.col("group").alias("g_c")), F.xxhash64("node", "bucket", F.lit(k))).alias("c"))
        star = live.join(stored(centre, "bucket-centres"), "bucket").filter(F.col("group") != F.col("c.g_c"))
        links.check(links.sign(star.select(F.col("node").alias("a"), F.col("c.c").alias("b"), F.col("n").alias("n_a"), F.col("c.n_c").alias("n_b"))))
        live = stored(_open_buckets(members.filter("members > 2"), links.groups()), "open-buckets")
    pool = _open_shingles(live, texts)
    links.add(_across(_possible(live, pool, percent), nodes, pool, percent))
    groups = links.groups()
    found = stored(classes.join(groups, "node", "left").select("n_shingles", "d1", "d2", F.coalesce("component", "node").alias("component_id")), "class-groups")
    # where rows of one doc_id differ, the least group of them holds for all
    out = full.select("doc_id", "text_hash", "n_shingles", "d1", "d2").join(found, ["n_shingles", "d1", "d2"]).select("doc_id", "n_shingles", "component_id", "text_hash")
    bare = sketched.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash")
    return out.unionByName(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _open_buckets(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of buckets that are not in one group yet, with their groups."""
    known = members.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    several = known.groupBy("bucket").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("bucket")
    return known.join(stored(several, "still-open"), "bucket", "left_semi")


def texts_for(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of the nodes; up to BROADCAST_NODES of them are broadcast to the documents, more
    are joined by a shuffle."""
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    return docs.join(wanted, docs["doc_id"] == wanted["node"]).select("node", "text")


def _across(left: DataFrame, nodes: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """Links a < b that unite nodes of different groups that share a bucket and whose full sets are
    alike; of links within two blocks only as many as unite the same nodes.

    A bucket's members are dealt to blocks of about BLOCK members or BLOCK_SHINGLES shingles, and
    each pair of blocks is a group of rows of its own, so that a task holds two blocks at a time.
    Signatures are compared first; a pair is told where the two first share a bucket. Only for nodes
    that are then still in a pair are the full sets fetched, again by pairs of blocks. pool has the
    nodes' shingles; shared bounds what a node can have in common.
    """
    blocks = left.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = left.join(stored(blocks, "block-numbers"), "bucket").select("bucket", "node", "n", "group", "shared", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    dealt = stored(dealt.join(nodes.select("node", "sig", "bands"), "node"), "dealt-nodes")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    key = ["bucket", "lo", "hi"]
    by_pair = dealt.select("*", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other")

    def candidates(batches):
        forget_encoders()
        batch_of = arrow_table(_CANDIDATES)
        for (bucket, lo, hi), columns in _groups(batches, key, ["node", "n", "group", "shared", "block", "sig", "bands"]):
            node, n, group, shared, block = (np.array(c, dtype=np.int64) for c in columns[:5])
            sig, bands = np.frombuffer(b"".join(columns[5]), dtype="<u4").reshape(len(node), -1), np.array(columns[6], dtype=np.int64)
            pairs: dict[int, list[int]] = {}
            for i in np.flatnonzero(block == lo).tolist():
                most = np.minimum(shared[i], shared)
                can = (block == hi) & (group != group[i]) & (100 * most >= percent * (n[i] + n - most)) & (100 * np.minimum(n[i], n) >= percent * np.maximum(n[i], n))
                if lo == hi:
                    can &= node > node[i]
                at = np.flatnonzero(can)
                at = at[(sig[at] == sig[i]).sum(axis=1) >= AGREE]
                if len(at):
                    first = bands[i][(bands[at] == bands[i]).argmax(axis=1)]
                    at = at[first == bucket]
                if len(at):
                    pairs[i] = node[at].tolist()
            met = {x for others in pairs.values() for x in others}
            rows = [(bucket, lo, hi, int(node[i]), int(group[i]), pairs.get(i, [])) for i in range(len(node)) if i in pairs or node[i] in met]
            for at in range(0, len(rows), 1000):
                yield batch_of([list(c) for c in zip(*rows[at : at + 1000])])

    found = by_pair.repartition(*key).sortWithinPartitions(*key).mapInArrow(candidates, fields(_CANDIDATES))
    asked = stored(found, "block-pairs")
    sets = stored(pool.join(asked.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_list("shingle")).alias("set")), "open-sets")

    def unite(batches):
        forget_encoders()
        batch_of = arrow_table(_PAIR)
        for _, (node, group, others, shingle) in _groups(slices(batches, column="set"), key, ["node", "group", "others", "set"]):
            own, top = dict(zip(node, shingle)), dict(zip(node, group))
            up: dict[int, int] = {}

            def root(x, up=up):
                while up.setdefault(x, x) != x:
                    up[x] = x = up[up[x]]
                return x

            links = []
            for x, ys in zip(node, others):
                for y in ys:
                    a, b = root(top[x]), root(top[y])
                    if a != b:
                        both = len(np.intersect1d(own[x], own[y], assume_unique=True))
                        if both and 100 * both >= percent * (len(own[x]) + len(own[y]) - both):
                            up[max(a, b)] = min(a, b)
                            links.append((min(x, y), max(x, y)))
            if links:
                yield batch_of([list(c) for c in zip(*links)])

    full = asked.join(sets, "node")
    return full.repartition(*key).sortWithinPartitions(*key).mapInArrow(unite, fields(_PAIR))


def _arrays(column) -> list[np.ndarray]:
    """The rows of an Arrow column of lists of longs, each in memory of its own."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b].copy() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _groups(batches, key: list[str], columns: list[str]):
    """(key, columns) of each run of rows that have the same key, as lists; of sets and bands as arrays of
    whole numbers, a fifth of the room that they would take as objects."""
    last, kept = None, [[] for _ in columns]
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in key)))
        values = [_arrays(b.column(c)) if c in ("set", "bands") else b.column(c).to_pylist() for c in columns]
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != last:
                if last is not None:
                    yield last, kept
                last, kept = keys[at], [[] for _ in columns]
            for have, more in zip(kept, values):
                have += more[at:end]
            at = end
    if last is not None:
        yield last, kept


def _open_shingles(live: DataFrame, texts: DataFrame) -> DataFrame:
    """node and shingle (a hash) of all nodes of open buckets."""
    schema = "node long, shingle long"

    def run(batches):
        forget_encoders()
        batch_of = arrow_table(schema)
        for b in slices(batches):
            for node, text in zip(b.column("node").to_pylist(), texts_of(b.column("text"))):
                s = shingles(text).view(np.int64)
                yield batch_of([np.full(len(s), node), s])

    nodes = live.select("node").distinct()
    return stored(texts_for(texts, stored(nodes, "open-nodes")).mapInArrow(run, fields(schema)).distinct(), "open-shingles")


def _possible(live: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """Adds shared, the number of a node's shingles that occur in another node of any open bucket,
    and leaves out nodes that can have no link: shared shingles are all that two can have in common."""
    common = stored(pool.groupBy("shingle").agg(F.count("*").alias("c")).filter("c > 1").select("shingle"), "common-shingles")
    shared = pool.join(common, "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("shared"))
    return live.join(stored(shared, "shared-shingles"), "node").filter(100 * F.col("shared") >= percent * F.col("n"))


def keep_first(docs: DataFrame, percent: int = 75, star_rounds: int = 3) -> DataFrame:
    """The documents without those that are near-duplicates of one with a smaller doc_id, their
    columns unchanged.

    Rows go by themselves: of rows with one doc_id only those go whose own text has a near-duplicate
    of a smaller doc_id. Repeated rows all go or all stay. Rows without a doc_id, a text or a word stay.
    An empty table gives an empty one. Further columns may have any names.
    """
    doc, text = free_name(docs, "gone"), free_name(docs, "gone_text")
    judged = _judged(docs, percent, star_rounds).filter(~F.col("kept"))
    gone = judged.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone[doc]) & (_text_hash() == gone[text]), "left_anti")
