"""Token ids of documents in files of Simple-8b blocks."""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.tables import shared_dir

from .common import arrow_table, encoder, fields, slices, texts_of
from .simple8b import pack, unpack

_BLOCKS = "part int, block int, first_id long, n_ids long, doc_ids array<long>, counts array<long>, word_counts array<long>, words binary"
_READ = "doc_id long, start long, n_tokens long, ids binary"


def write_blocks(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, block_ids: int = 1 << 16) -> None:
    """Encodes each whole text, appends end_id, and writes documents in ascending doc_id order as
    blocks of about block_ids ids.

    A row of the written Parquet table is a block: its file part, its number there, the number of
    ids before it in the part, and for its documents the doc_ids, id counts and word counts, so any
    document can be decoded without the others. Texts are dealt by ranges of doc_id before they are
    encoded, so that finding the ranges encodes nothing.
    """

    def run(batches):
        part, block, first = TaskContext.get().partitionId(), 0, 0
        coder, batch_of = encoder(tokenizer_path), arrow_table(_BLOCKS)
        end = np.uint32(end_id).tobytes()
        doc_ids, ids, n = [], [], 0

        def close():
            counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            words, sizes = pack(np.frombuffer(b"".join(ids), dtype="<u4"), counts)
            return batch_of([[part], [block], [first], [n], [doc_ids], [counts], [sizes], [words.astype("<u8").tobytes()]])

        for b in slices(batches):
            for doc, x in zip(b.column("doc_id").to_pylist(), coder.encode(texts_of(b.column("text")))):
                doc_ids.append(doc)
                ids.append(x + end)
                n += len(x) // 4 + 1
                if n >= block_ids:
                    yield close()
                    block, first, doc_ids, ids, n = block + 1, first + n, [], [], 0
        if ids:
            yield close()

    order = ["doc_id", "text"]
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rows.repartitionByRange("doc_id").sortWithinPartitions(*order).mapInArrow(run, fields(_BLOCKS)).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned
    32-bit) of every document in the files."""
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))

    def run(batches):
        batch_of = arrow_table(_READ)
        for b in batches:
            for ids, counts, sizes, words, start in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "counts", "word_counts", "words", "start"))):
                values = unpack(np.frombuffer(words, dtype="<u8"))
                counts = np.array(counts, dtype=np.int64)
                if len(values) != counts.sum() or len(words) != 8 * sum(sizes):
                    raise ValueError("a block does not hold what its counts say")
                raw, ends = values.astype("<u4").tobytes(), np.cumsum(counts)
                starts = ends - counts
                yield batch_of([ids, start + starts, counts, [raw[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist())]])

    # a row for each part
    return blocks.join(F.broadcast(parts), "part").select("doc_ids", "counts", "word_counts", "words", (F.col("part_start") + F.col("first_id")).alias("start")).mapInArrow(run, fields(_READ))


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Encodes, writes and reads back: doc_id, start, n_tokens, ids.

    Null texts count as empty: only end_id. Rows with a null doc_id come first. Rows with the same
    doc_id all stay, ordered by their texts. An empty table gives no rows. Other columns are ignored.
    """
    import uuid

    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-blocks-{uuid.uuid4().hex}"
    write_blocks(docs, path, tokenizer_path, end_id)
    return read_blocks(spark, path)


def ids_digest(read: DataFrame) -> DataFrame:
    """Replaces ids by ids_crc32, their unsigned CRC-32."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    return crc32(np.asarray(ids, dtype="<u4").tobytes())
