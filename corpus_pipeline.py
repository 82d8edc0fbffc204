"""A pipeline over documents: language, lines, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and, but for the last,
returns the columns of documents. What a stage does with odd rows is its operator's: null and empty
texts go in the language stage and would stay in the others; rows go by themselves, so a
clean row stays whatever others of its doc_id, or of none, hold; repeated rows stay or go together. Each stage makes an empty table of an empty one. Further columns of documents stay, whatever
their names; packing returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontam, langid, line_dedup, minhash, packing
from codeloom.llm.common import stored
from codeloom.llm.queries import BYTE_BPE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that its calibrated rejection turns down go."""
    return langid.accepted(docs, langid.train(docs.filter(langid.learnable())))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: lines that an earlier line equals or nearly equals go; all documents stay."""
    return line_dedup.without_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group the document with the smallest doc_id stays."""
    return minhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a passage of a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the pieces of the packed sequences."""
    return packing.pack_along_curve(docs, BYTE_BPE)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: Language models can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
