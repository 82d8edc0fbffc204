"""Duplicated blocks, text search and symbol search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.lines import lines_of, squeezed


def clone_groups(texts: DataFrame, key: str, size: int = 6) -> DataFrame:
    """Blocks of so many lines that occur twice or more, in normal form and without blank lines:
    block (SHA-256), occurrences, files, first_file and first_line.

    Windows are cut within a text's own row; only their digests travel, aggregated before the
    shuffle, so a block that all texts share is no large group.
    """
    lines = F.transform(F.split("text", "\r?\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), squeezed(x).alias("line")))
    kept = texts.select(key, F.filter(lines, lambda x: x["line"].isNotNull()).alias("kept"))
    flat = kept.select(key, F.transform("kept", lambda x: x["line"]).alias("lines"), F.transform("kept", lambda x: x["line_no"]).alias("numbers"))
    # digests are made inside the row and only they are exploded, so a start carries no copy of the lines
    block = lambda at: F.struct(F.get("numbers", at).alias("line_no"), F.sha2(F.array_join(F.slice("lines", at + 1, F.lit(size)), "\n"), 256).alias("block"))
    blocks = F.when(F.size("lines") >= size, F.transform(F.sequence(F.lit(0), F.size("lines") - size), block))
    hashed = flat.select(key, F.explode(blocks).alias("b")).select(key, "b.line_no", "b.block")
    per_file = hashed.groupBy("block", key).agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    groups = per_file.groupBy("block").agg(F.sum("n").alias("occurrences"), F.count("*").alias("files"), F.min(F.struct(key, "line_no")).alias("first")).filter("occurrences > 1")
    return groups.select("block", "occurrences", "files", F.col(f"first.{key}").alias("first_file"), F.col("first.line_no").alias("first_line"))


def search_lines(texts: DataFrame, key: str, needle: str, limit: int = 100) -> DataFrame:
    """The first hit in each line that contains needle, case aside: key, line_no, column_no, line; in
    order of key and line, at most limit."""
    hit = F.locate(needle.lower(), F.lower("line"))
    return lines_of(texts, key).withColumn("column_no", hit).filter("column_no > 0").select(key, "line_no", "column_no", "line").orderBy(key, "line_no").limit(limit)


def search_symbols(symbols: DataFrame, needle: str, limit: int = 50) -> DataFrame:
    """Symbols whose name contains needle, case aside; exported ones first, then short names."""
    return symbols.filter(F.lower("name").contains(needle.lower())).orderBy(F.desc("is_exported"), F.length("name"), "name", "path").limit(limit)


def search_all(files: DataFrame, folders: DataFrame, symbols: DataFrame, needle: str, limit: int = 50) -> DataFrame:
    """kind, label, path of files, folders and symbols that contain needle, in this order of kinds."""
    parts = [
        files.filter(F.lower("path").contains(needle.lower())).select(F.lit(1).alias("kind_rank"), F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("label"), "path"),
        folders.filter(F.lower("folder").contains(needle.lower())).select(F.lit(2), F.lit("folder"), "folder", "folder"),
        symbols.filter(F.lower("name").contains(needle.lower())).select(F.lit(3), F.lit("symbol"), "name", "path"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).orderBy("kind_rank", "path", "label").limit(limit)


def html_references(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, tag, target and n of what pages depend on: src of scripts, images, frames and sources,
    href of links. Values may stand in quotes of either kind or in none."""
    value = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    found = []
    for pattern in (rf"(?i)<(script|img|iframe|source)\b[^>]*?\ssrc{value}", rf"(?i)<(link)\b[^>]*?\shref{value}"):
        found.append(F.arrays_zip(*(F.regexp_extract_all(html, F.lit(pattern), F.lit(k)).alias(c) for k, c in ((1, "tag"), (2, "target")))))
    target = F.regexp_replace("r.target", """^["']|["']$""", "")
    return pages.select(key, F.explode(F.concat(*found)).alias("r")).groupBy(key, F.lower("r.tag").alias("tag"), target.alias("target")).agg(F.count("*").alias("n"))
