"""Toxicity scores by FTRL-proximal logistic regression on hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_table, fields, mix, slices, stored, texts_of, word_hashes, word_spans

_EXAMPLES = "y int, features binary"
_WEIGHTS = "feature long, weight double, shards long"
_SCORED = "doc_id long, score double, predicted int"
#: ASCII punctuation separates words here; A-Z are lower-cased.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def features(text: bytes, bits: int) -> np.ndarray:
    """The distinct hashed features of a text: words, pairs of neighbours, and pairs with one word
    between them. Feature 0 is the intercept."""
    plain = text.translate(_PLAIN)
    starts, ends = word_spans(plain)
    h = word_hashes(plain, starts, ends)
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])
        skips = mix(h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:] + np.uint64(7))
    return np.unique(np.concatenate((h, pairs, skips)) >> np.uint64(64 - bits)).astype(np.uint32)


@dataclass
class Model:
    """Weights by feature, sorted; only those that L1 leaves."""

    bits: int
    index: np.ndarray
    weight: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, dtype=np.float32)
        out[self.index] = self.weight
        return out


class Ftrl:
    """FTRL-proximal: each coordinate has its own rate, and L1 sets small ones to 0."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the intercept
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def learnable(doc_id: str = "doc_id") -> Column:
    """Whether a row's label may be learned from: crc32 of its doc_id as text is not 0 modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = 8000, bits: int = 20, shards: int = 8, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0) -> Model:
    """Fits on a bounded sample of labelled documents, about per_class of each class.

    The sample is those labelled rows with the smallest hashes of their doc_id; a document with
    several labels has the largest. It is dealt to at most that many shards, fewer if toxic examples
    are few, that learn by themselves; their weights are averaged. The intercept is then moved by the classes' true shares. Labels that are
    null, and labels without a document or with a null text, teach nothing. Without labels of both
    classes every score is 0.5, or as the one class says.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Model(bits, np.zeros(0, np.int64), np.zeros(0), 0.0 if not sizes else (20.0 if 1 in sizes else -20.0))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, per_class / sizes[1]).otherwise(per_class / sizes[0])
    chosen = known.filter(place < share)

    def make(batches):
        batch_of = arrow_table(_EXAMPLES)
        for b in slices(batches):
            yield batch_of([b.column("y"), [features(t, bits).tobytes() for t in texts_of(b.column("text"))]])

    # at most about 2 * per_class pairs of integers
    sample = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("y", "text").mapInArrow(make, fields(_EXAMPLES))
    examples = stored(sample.withColumn("_at", F.xxhash64("features")), "toxic-examples")

    def learn(batches):
        model, rows, intercept = Ftrl(bits, alpha, beta, l1, l2), [], np.array([1 << bits])
        for b in batches:
            rows += [(y, np.append(np.frombuffer(x, dtype=np.uint32).astype(np.int64), intercept)) for y, x in zip(b.column("y").to_pylist(), b.column("features").to_pylist())]
        random = np.random.default_rng(len(rows))
        for _ in range(epochs if rows else 0):
            for i in random.permutation(len(rows)).tolist():
                model.learn(rows[i][1], rows[i][0])
        if rows:
            w = model.weights(np.arange((1 << bits) + 1))
            at = np.flatnonzero(w)
            at = np.append(at[at != 1 << bits], 1 << bits)
            yield arrow_table(_WEIGHTS)([at, w[at], np.ones(len(at), dtype=np.int64)])

    dealt = {y: min(n, per_class) for y, n in sizes.items()}
    shards = max(1, min(shards, dealt[1] // 1500))  # a shard needs enough examples of the rarer class
    learned = examples.repartition(shards, F.pmod("_at", F.lit(shards))).sortWithinPartitions("_at").select("y", "features").mapInArrow(learn, fields(_WEIGHTS))
    found = learned.groupBy("feature").agg(F.sum("weight").alias("w"), F.sum("shards").alias("n")).orderBy("feature").toArrow()  # at most 2 ** bits rows
    at, w, n = (found.column(c).to_numpy() for c in ("feature", "w", "n"))
    at, w = at.astype(np.int64), w.astype(np.float64)
    taught = max([1, *n[at == 1 << bits].tolist()])
    w /= taught
    shift = math.log(sizes[1] / sizes[0]) - math.log(dealt[1] / dealt[0])
    real = at < 1 << bits
    return Model(bits, at[real], w[real], float(w[~real].sum()) + shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted (1 from 0.5 on) for every whole text.

    Null and empty texts get the intercept's score. Rows are judged one by one. An empty table gives
    no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** bits weights

    def run(batches):
        batch_of, weights, m = arrow_table(_SCORED), shared.value.dense(), shared.value
        for b in slices(batches):
            s = [1 / (1 + math.exp(-max(-35.0, min(35.0, m.intercept + float(weights[features(t, m.bits)].sum()))))) for t in texts_of(b.column("text"))]
            yield batch_of([b.column("doc_id"), s, [int(x >= 0.5) for x in s]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields(_SCORED))
