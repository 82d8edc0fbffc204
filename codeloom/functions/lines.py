"""Lines of texts: splitting, normalising, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: what a marker comment looks like.
MARKER = r"(?i)(?:^|//|#|--|/\*)\s*(TODO|FIXME|HACK)\b[:\s-]*(.*)$"


def lines_of(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no (from 1) and line; lines end with a line feed, with or without a carriage return."""
    return texts.select(key, F.posexplode(F.split(text, "\r?\n", -1)).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def squeezed(line: Column) -> Column:
    """A line without white space at its ends, other runs of it one space; null if nothing but
    brackets, commas and semicolons is left."""
    trimmed = F.regexp_replace(F.regexp_replace(line, r"^\s+", ""), r"\s+$", "")
    return F.when((trimmed != "") & ~trimmed.rlike(r"^[{}();,]+$"), F.regexp_replace(trimmed, r"\s+", " "))


def markers(lines: DataFrame, key: str) -> DataFrame:
    """TODO, FIXME and HACK comments: key, line_no, tag and up to 200 characters of what follows."""
    hit = lines.filter(F.col("line").rlike(MARKER))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract("line", MARKER, 2), r"^\s+", ""), r"\s+$", "")
    return hit.select(key, "line_no", F.upper(F.regexp_extract("line", MARKER, 1)).alias("tag"), F.left(rest, F.lit(200)).alias("note"))


def merge_conflicts(lines: DataFrame, key: str) -> DataFrame:
    """Conflict groups: key, start_line, end_line (null if there is none), complete and label.

    A group lasts from a start marker to the first end marker before the next start; it is complete
    if it has an end and a separator lies before that. Only marker lines go into the window.
    """
    kind = F.when(F.col("line").rlike("^<{7}( |$)"), 1).when(F.col("line").rlike("^={7}$"), 2).when(F.col("line").rlike("^>{7}( |$)"), 3)
    marked = lines.withColumn("kind", kind).filter("kind IS NOT NULL")
    nth = F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("line_no"))
    groups = marked.withColumn("g", nth).filter("g > 0").groupBy(key, "g").agg(
        F.min(F.when(F.col("kind") == 1, F.col("line_no"))).alias("start_line"),
        F.min(F.when(F.col("kind") == 3, F.col("line_no"))).alias("end_line"),
        F.min(F.when(F.col("kind") == 2, F.col("line_no"))).alias("_mid"),
        F.max(F.when(F.col("kind") == 1, F.trim(F.substring("line", 8, 1 << 30)))).alias("label"),
    )
    complete = F.coalesce(F.col("end_line").isNotNull() & (F.col("_mid") < F.col("end_line")), F.lit(False))
    return groups.select(key, "start_line", "end_line", complete.alias("complete"), "label")
