"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_table, fields, forget_encoders, mix, slices

_LETTERS = re.compile(r"[^\W\d_]+")
_FIRST, _LAST = "\x02", "\x03"
_COUNTS = "lang string, gram string, n long"
_MEASURED = "lang string, sums array<double>"
_SCORED = "lang_pred string, score double, bits_per_char double, rejected boolean"


#: Text that a task splits into words at a time.
PART_BYTES = 2 << 20


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; the models' input."""
    return _LETTERS.findall(text.lower())


def _gram_hash(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of codes[at - size + 1 .. at] for each position."""
    out = np.full(len(at), size, dtype=np.uint64)
    for i in range(size - 1, -1, -1):
        out = out * np.uint64(0x9FB21C651E98DF25) + codes[at - i] + np.uint64(1)
    return mix(out)


class _Table:
    """A sorted array of hashes and rows of values for them."""

    def __init__(self, grams: list[str], values: np.ndarray) -> None:
        hashes = np.array([_gram_hash(np.array([ord(c) for c in g], dtype=np.uint64), np.array([len(g) - 1]), len(g))[0] for g in grams], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, at


@dataclass
class Models:
    """All languages' models in one set of arrays: a gram's row has a value for each language."""

    langs: list[str]
    order: int
    unseen: np.ndarray  # probability of a character that no gram has, by language
    probs: list[_Table]  # by size of gram, from 1
    backs: list[_Table | None]  # by size of context plus 1: the share left for shorter contexts
    reject_at: np.ndarray | None = None  # by language: mean, variance per character, variance between documents, greatest z
    reject_bits: float = 2.5  # a document this close to its language's mean, in bits per character, is never rejected

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural-log probability of each word with its end, by language; the last column counts its characters."""
        if not self.langs:
            return np.array([[float(len(w) + 1)] for w in words])
        text = "".join(_FIRST + w + _LAST for w in words)
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        is_first = codes == ord(_FIRST)
        owner = np.cumsum(is_first) - 1
        depth = np.arange(len(codes)) - np.flatnonzero(is_first)[owner]
        at = np.flatnonzero(~is_first)
        p = np.tile(self.unseen, (len(at), 1))
        for size in range(1, self.order + 1):
            rows = np.flatnonzero(depth[at] >= size - 1)
            if not len(rows):
                break
            here = at[rows]
            if size > 1 and self.backs[size - 1] is not None:
                known, where = self.backs[size - 1].find(_gram_hash(codes, here - 1, size - 1))
                p[rows[known]] *= self.backs[size - 1].values[where[known]]
            found, where = self.probs[size - 1].find(_gram_hash(codes, here, size))
            p[rows[found]] = self.probs[size - 1].values[where[found]]
        out = np.zeros((len(words), len(self.langs) + 1))
        logs = np.log(p)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner[at], weights=logs[:, k], minlength=len(words))
        out[:, -1] = np.bincount(owner[at], minlength=len(words))
        return out


class Scorer:
    """Scores texts; scores of words that were seen are kept, at most memo_words of them."""

    def __init__(self, models: Models, memo_words: int = 100_000) -> None:
        self.models, self.memo_words = models, memo_words
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(models.langs) + 1))

    def sums(self, texts: list[str]) -> np.ndarray:
        """For each text the log probabilities by language and the number of characters scored."""
        split = [words_of(t) for t in texts]
        if len(self.rows) > self.memo_words:
            self.rows, self.table = {}, self.table[:0]
        new = list({w for ws in split for w in ws if w not in self.rows})
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            # some 150 bytes a character while words are scored, so few at a time
            scores = np.concatenate([self.models.word_scores(new[k : k + 10_000]) for k in range(0, len(new), 10_000)])
            scores[[not any(c.isalpha() for c in w) for w in new]] = 0  # superscripts, fractions and the like are no letters
            self.table = np.concatenate((self.table, scores))
        get = self.rows.__getitem__
        return np.array([self.table[np.fromiter(map(get, ws), dtype=np.int64, count=len(ws))].sum(axis=0) for ws in split]).reshape(len(texts), -1)


def learnable(doc_id: str = "doc_id") -> Column:
    """Whether a row is one to learn from: crc32 of its doc_id as text is not 2 modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def sample_by_lang(docs: DataFrame, per_lang: int, lang_bytes: int, total_bytes: int) -> DataFrame:
    """About per_lang documents, or lang_bytes of text, of every language: those documents with the
    smallest hashes of their doc_id. Where there are so many languages that this is more than
    total_bytes, each gives an equal part of that, and its first document at least."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), (F.sum(F.octet_length("text")) + 1).alias("bytes"), F.min(place).alias("_least"))
    langs = F.count("*").over(Window.partitionBy())  # of a row for each language
    each = F.least(F.lit(lang_bytes), total_bytes / langs)
    shares = sizes.select("lang", F.least(per_lang / F.col("n"), each / F.col("bytes")).alias("_share"), "_least")
    return rows.join(F.broadcast(shares), "lang").filter((place < F.col("_share")) | (place == F.col("_least"))).select("doc_id", "text", "lang", (place == F.col("_least")).alias("first"))  # a row for each language


def count_grams(sample: DataFrame, order: int) -> DataFrame:
    """How often each gram of order characters, or a shorter one at a word's start, occurs by language."""

    def run(batches):
        forget_encoders()
        counts: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                own = counts.setdefault(lang, Counter())
                for w, n in Counter(words_of(text)).items():
                    s = _FIRST + w + _LAST
                    for i in range(1, len(s)):
                        own[s[max(0, i - order + 1) : i + 1]] += n
        batch_of = arrow_table(_COUNTS)
        for lang, own in counts.items():
            yield batch_of([[lang] * len(own), list(own), list(own.values())])

    return sample.select("lang", "text").mapInArrow(run, fields(_COUNTS)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(counts: dict[str, dict[str, int]], order: int) -> Models:
    """Interpolated Kneser-Ney models from the counts of the longest grams.

    Shorter grams count by how many characters they follow, except at a word's start, where they
    count as they are. One absolute discount a size, n1 / (n1 + 2 n2), goes to the shorter contexts.
    """
    langs = sorted(counts)
    letters = {c for own in counts.values() for g in own for c in g}
    uniform = 1.0 / (len(letters) + 1)
    sizes: list[list[dict[str, int]]] = [[{} for _ in langs] for _ in range(order)]
    for k, lang in enumerate(langs):
        sizes[order - 1][k] = {g: n for g, n in counts[lang].items() if len(g) == order}
        short = {g: n for g, n in counts[lang].items() if len(g) < order}
        for size in range(order - 1, 0, -1):
            follows: Counter = Counter(g[1:] for g in sizes[size][k])
            follows.update({g: n for g, n in short.items() if len(g) == size})
            sizes[size - 1][k] = dict(follows)
    probs: list[_Table] = []
    backs: list[_Table | None] = []
    lower: dict[str, np.ndarray] = {}
    for size in range(1, order + 1):
        level = sizes[size - 1]
        sums: dict[str, np.ndarray] = {}
        kinds: dict[str, np.ndarray] = {}
        discount = np.full(len(langs), 0.5)
        for k in range(len(langs)):
            ones, twos = sum(n == 1 for n in level[k].values()), sum(n == 2 for n in level[k].values())
            discount[k] = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5
            for g, n in level[k].items():
                sums.setdefault(g[:-1], np.zeros(len(langs)))[k] += n
                kinds.setdefault(g[:-1], np.zeros(len(langs)))[k] += 1
        rest = {h: np.where(s > 0, discount * kinds[h] / np.maximum(s, 1), 1.0) for h, s in sums.items()}
        if size == 1:
            unseen = uniform * rest.get("", np.ones(len(langs)))
        grams = sorted({g for own in level for g in own})
        values = np.zeros((len(grams), len(langs)))
        for i, g in enumerate(grams):
            h = g[:-1]
            shorter = lower.get(g[1:]) if size > 1 else None
            if shorter is None:
                shorter = np.full(len(langs), uniform)
            seen = np.array([own.get(g, 0) for own in level], dtype=float)
            values[i] = np.maximum(seen - discount, 0) / np.maximum(sums[h], 1) + rest[h] * shorter
        lower = dict(zip(grams, values))
        probs.append(_Table(grams, values))
        contexts = sorted(rest)
        backs.append(_Table(contexts, np.array([rest[h] for h in contexts])) if size > 1 else None)
    return Models(langs, order, unseen, probs, backs)


def calibrate(models: Models, langs: list[str], sums: np.ndarray, slack: float = 3.0) -> Models:
    """Sets when a best language is rejected, from the languages and sums (see Scorer) of documents that
    the counts do not hold.

    A document's bits per character vary about its language's mean with a part that shrinks with
    length and one that does not. It is rejected beyond what 95 in 100 of the given documents deviate,
    plus slack standard deviations, and only if it is also reject_bits off: texts of two languages, or
    with names, numbers and addresses, stay, as do those too close to be told apart. Medians take the
    place of means, so a few junk documents among the labelled ones do not lift the bar. What goes is
    what no model explains.
    """
    out = np.zeros((len(models.langs), 4))
    for k, lang in enumerate(models.langs):
        own = np.array([i for i, x in enumerate(langs) if x == lang and sums[i, -1] > 0], dtype=int)
        if not len(own):
            out[k] = 0, 0, 0, np.inf
            continue
        n = sums[own, -1]
        per = -sums[own, k] / n
        mean = np.median(per)
        by_char = np.median((per - mean) ** 2 * n) * 2.2 + 0.05
        between = float(1.4826 * np.median(np.abs(per[n >= np.median(n)] - mean))) ** 2
        z = (per - mean) / np.sqrt(by_char / n + between)
        out[k] = mean, by_char, between, max(6.0, float(np.quantile(z, 0.95))) + slack
    models.reject_at = out
    return models


def train(docs: DataFrame, per_lang: int = 1000, order: int = 4, lang_bytes: int = 16 << 20, total_bytes: int = 512 << 20) -> Models:
    """Models from a bounded sample of whole texts: about per_lang documents, or lang_bytes of text, of
    each language, and total_bytes of all.

    A tenth of the sample calibrates the rejection and is not counted, but for a language's first document. The counts come to the
    driver, bounded by the sample; of the documents that calibrate only their sums do. Rows with a
    null text or lang teach nothing. Without any row to learn from there are no models, and every
    prediction is und.
    """
    sample = sample_by_lang(docs, per_lang, lang_bytes, total_bytes)
    part = F.pmod(F.hash("doc_id"), F.lit(10))
    counts: dict[str, dict[str, int]] = {}
    for lang, gram, n in count_grams(sample.filter((part != 0) | F.col("first")), order).collect():
        counts.setdefault(lang, {})[gram] = n
    models = fit(counts, order)
    if not counts:
        return models
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the training sample

    def measure(batches):
        forget_encoders()
        scorer, batch_of = Scorer(shared.value), arrow_table(_MEASURED)
        for b in slices(batches, PART_BYTES):
            yield batch_of([b.column("lang"), scorer.sums(b.column("text").to_pylist()).tolist()])

    rows = sample.filter((part == 0) & ~F.col("first")).select("lang", "text").mapInArrow(measure, fields(_MEASURED)).collect()
    return calibrate(models, [r.lang for r in rows], np.array([r.sums for r in rows]).reshape(len(rows), len(models.langs) + 1))


def decide(models: Models, sums: np.ndarray) -> list[tuple]:
    """(lang_pred, score, bits_per_char, rejected) from the sums of a Scorer."""
    out = []
    for row in sums:
        n = row[-1]
        if n == 0 or not models.langs:
            out.append(("und", 0.0, None, bool(n == 0)))
            continue
        per = -row[:-1] / n
        best = int(np.argmin(per))
        score = 1.0 / np.exp((per[best] - per) * min(n, 40)).sum()
        mean, by_char, between, most = models.reject_at[best]
        off = per[best] - mean
        rejected = bool(np.isfinite(most) and off / np.log(2) > models.reject_bits and off / np.sqrt(by_char / n + between) > most)
        out.append((models.langs[best], float(score), float(per[best] / np.log(2)), rejected))
    return out


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """Adds lang_pred, score, bits_per_char and rejected to the documents, by their text alone.

    lang_pred is the language whose model gives the lowest cross-entropy per character, of equals the
    first by name; score is its share among the languages at up to 40 characters' worth of evidence.
    Null texts and those with no letter get und, score 0, and are rejected. Without models all texts
    get und and score 0, and those with a letter are not rejected. Other columns stay as they are;
    those of the names added are replaced. Rows are judged one by one, so repeated rows have the same
    result, and an empty table gives no rows.
    """
    kept = docs.drop(*(f.name for f in fields(_SCORED)))
    out_schema = kept.select().schema
    for f in [*kept.schema.fields, *fields(_SCORED).fields]:
        out_schema = out_schema.add(f)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)  # bounded by the training sample

    def run(batches):
        forget_encoders()
        scorer = Scorer(shared.value)
        batch_of = arrow_table(_SCORED)
        import pyarrow as pa

        for b in slices(batches, PART_BYTES):
            texts = [t or "" for t in b.column("text").to_pylist()]
            added = batch_of([list(c) for c in zip(*decide(shared.value, scorer.sums(texts)))])
            yield pa.RecordBatch.from_arrays([*b.columns, *added.columns], names=[*b.schema.names, *added.schema.names])

    return kept.mapInArrow(run, out_schema)


def accepted(docs: DataFrame, models: Models) -> DataFrame:
    """The documents that identify() does not reject, their columns unchanged.

    Rows are judged one by one, so repeated rows go or stay together. Null texts and those without a
    letter go. An empty table gives an empty one. Further columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the training sample

    def run(batches):
        forget_encoders()
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for b in slices(batches, PART_BYTES):
            keep = [not row[3] for row in decide(shared.value, scorer.sums([t or "" for t in b.column("text").to_pylist()]))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
