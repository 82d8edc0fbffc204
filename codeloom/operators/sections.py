"""Comparison of two snapshots in sections: identity by meaning, deltas, filters, cursors, freshness."""

from __future__ import annotations

import base64
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from codeloom.functions.canonical import canonical_json, canonical_key
from codeloom.functions.ids import under

# Filters that a section knows, and the names of its directions.
FILTERS = {
    "files": ("changeTypes", "gitStates", "languages", "folderPrefix"),
    "edges": ("deltaDirections", "languages", "folderPrefix"),
    "findings": ("deltaDirections", "findingTypes", "severities", "languages", "folderPrefix"),
    "architecture-violations": ("deltaDirections", "severities", "languages", "folderPrefix"),
    "cycles": ("deltaDirections", "folderPrefix"),
    "reachable-exports": ("deltaDirections", "languages", "folderPrefix"),
    "affected-files": ("directness", "languages", "folderPrefix", "minDepth", "maxDepth"),
    "candidate-tests": ("directness", "languages", "folderPrefix", "minDepth", "maxDepth"),
    "no-known-tests": ("languages", "folderPrefix"),
    "limitations": (),
}
DIRECTIONS = {"edges": ("added", "removed"), "findings": ("introduced", "resolved"), "architecture-violations": ("introduced", "resolved"), "cycles": ("added", "removed"), "reachable-exports": ("added", "removed")}
# The column that each list of a filter holds against.
_LISTS = {"changeTypes": "change_type", "gitStates": "git_state", "findingTypes": "finding_type", "severities": "severity", "deltaDirections": "direction", "directness": "directness", "languages": "language"}


def edge_key() -> Column:
    return canonical_key(fromPath="from_path", toPath="to_path", edgeType="edge_type", typeOnly="type_only")


def finding_key() -> Column:
    return canonical_key(findingType="finding_type", fingerprint="fingerprint")


def violation_key() -> Column:
    return canonical_key(ruleId="rule_id", ruleFingerprint="rule_fingerprint", sourcePath="source_path", targetPath="target_path")


def cycle_key() -> Column:
    return canonical_key(memberPaths=F.array_sort(F.array_distinct("member_paths")))


def member_key() -> Column:
    """Of a cycle told by the digest of its members' set, so that no list of them is made."""
    return canonical_key(members="identity")


def export_key() -> Column:
    return canonical_key(entryPoint="entry_point", exportedName="exported_name", symbolKind="symbol_kind", originPath="origin_path")


def section_delta(baseline: DataFrame, target: DataFrame, key: Column, section: str) -> DataFrame:
    """stable_key, direction and the columns of the rows whose key only one snapshot has.

    Of a side's rows with one key the one whose canonical JSON sorts first stands for all, so the
    order in which they come does not matter. Both sides meet in one aggregation.
    """
    columns = target.columns
    row, (new, gone) = F.struct(*columns), DIRECTIONS[section]
    text = canonical_json(**{c: c for c in columns})
    sides = [df.select(*columns).select(key.alias("stable_key"), row.alias("row"), text.alias("text"), F.lit(side).alias("side")) for side, df in (("b", baseline), ("t", target))]
    met = sides[0].unionByName(sides[1]).groupBy("stable_key").agg(F.min("side").alias("lo"), F.max("side").alias("hi"), F.min_by("row", "text").alias("row"))
    return met.filter("lo = hi").select("stable_key", F.when(F.col("lo") == "t", new).otherwise(gone).alias("direction"), "row.*")


def check_comparable(baseline: DataFrame, target: DataFrame, fields: list[str]) -> None:
    """Raises ValueError unless the snapshots (a row each, with side) agree in all the fields."""
    b, t = baseline.select("side", *fields).first(), target.select("side", *fields).first()
    if b is None or t is None or b.side != "baseline" or t.side != "target" or any(b[f] != t[f] for f in fields):
        raise ValueError("the snapshots can't be compared: they differ in commit, tree or configuration")


def filtered(rows: DataFrame, section: str, filters: dict, path: str = "path") -> DataFrame:
    """A section's rows under filters: lists of values, folderPrefix, minDepth and maxDepth.

    An empty list and None say nothing. A filter that the section does not know is an error, so is a
    direction that it has no name for, and a least depth above the greatest.
    """
    used = {k: v for k, v in filters.items() if v not in (None, [], ())}
    unknown = set(used) - set(FILTERS[section])
    wrong = set(used.get("deltaDirections", ())) - set(DIRECTIONS.get(section, ()))
    if unknown or wrong:
        raise ValueError(f"{section} has no filter for {sorted(unknown | wrong)}")
    if used.get("minDepth") is not None and used.get("maxDepth") is not None and used["minDepth"] > used["maxDepth"]:
        raise ValueError("minDepth is above maxDepth")
    for name, value in used.items():
        if name in _LISTS:
            rows = rows.filter(F.col(_LISTS[name]).isin(list(value)))
        elif name == "folderPrefix":
            rows = rows.filter(under(F.col(path), value.rstrip("/")))
        else:
            rows = rows.filter(F.col("depth") >= value if name == "minDepth" else F.col("depth") <= value)
    return rows


def encode_cursor(review: int, section: str, offset: int) -> str:
    """An opaque mark of a place in a section."""
    if review < 1 or offset < 0 or section not in FILTERS:
        raise ValueError("no such place")
    text = json.dumps({"offset": offset, "reviewId": review, "section": section}, sort_keys=True, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[int, str, int]:
    """(review, section, offset); ValueError for anything that encode_cursor does not make."""
    if not re.fullmatch("[A-Za-z0-9_-]+", cursor):
        raise ValueError("no cursor")
    try:
        value = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        place = value["reviewId"], value["section"], value["offset"]
        known = all(type(x) is int for x in (place[0], place[2])) and encode_cursor(*place) == cursor
    except (ValueError, TypeError, KeyError) as e:
        raise ValueError("no cursor") from e
    if not known:
        raise ValueError("no cursor")
    return place


def cursor_page(rows: DataFrame, order: list[str], review: int, section: str, cursor: str | None = None, size: int = 100) -> tuple[DataFrame, str | None]:
    """size rows of a section in a total order from the cursor's place on, and the next cursor, None at
    the end. size is 1 to 500. A cursor of another review or section is an error."""
    if not 1 <= size <= 500:
        raise ValueError("size must be from 1 to 500")
    at = (review, section, 0) if cursor is None else decode_cursor(cursor)
    if at[:2] != (review, section):
        raise ValueError("the cursor is of another review or section")
    found = rows.orderBy(*order).offset(at[2]).limit(size + 1).collect()
    page = rows.sparkSession.createDataFrame(found[:size], rows.schema)
    return page, encode_cursor(review, section, at[2] + size) if len(found) > size else None


def merged_limitations(rows: DataFrame) -> DataFrame:
    """stable_key, scope, code, paths (distinct, sorted), message and omitted, the greatest count, of the
    distinct limitations by scope, code and paths; of messages the first in order."""
    plain = rows.withColumn("paths", F.array_sort(F.array_distinct("paths")))
    keyed = plain.withColumn("stable_key", canonical_key(scope="scope", code="code", paths="paths"))
    return keyed.groupBy("stable_key").agg(F.min("scope").alias("scope"), F.min("code").alias("code"), F.min("paths").alias("paths"), F.min("message").alias("message"), F.max("omitted").alias("omitted"))


def first_limitations(rows: DataFrame, keep: int = 500) -> DataFrame:
    """text and its first place (at), of distinct texts the keep that come first."""
    return rows.groupBy("text").agg(F.min("at").alias("at")).orderBy("at", "text").limit(keep)


def united_evidence(structural: DataFrame, impact: DataFrame, key: list[str]) -> DataFrame:
    """Both kinds of evidence, a row for each key; where both have it, the structural one."""
    both = structural.withColumn("_r", F.lit(0)).unionByName(impact.withColumn("_r", F.lit(1)))
    return both.groupBy(*key).agg(F.min_by(F.struct(*structural.columns), F.struct("_r", *structural.columns)).alias("r")).select("r.*")


def freshness(reviews: DataFrame, now: DataFrame, key: str, parts: dict[str, str], version: str) -> DataFrame:
    """key, freshness (current, stale or incompatible) and reasons: the names of the parts, columns of
    both tables, that differ by now. A review of another version is incompatible."""
    other = now.select(key, F.col(version).alias("_v"), *(F.col(c).alias(f"_{c}") for c in parts))
    both = reviews.join(other, key)
    reasons = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), name) for c, name in parts.items())))
    kind = F.when(F.col(version) != F.col("_v"), "incompatible").when(F.size(reasons) > 0, "stale").otherwise("current")
    return both.select(key, kind.alias("freshness"), F.when(F.col(version) == F.col("_v"), reasons).otherwise(F.array().cast("array<string>")).alias("reasons"))


def tree_fingerprint(rows: DataFrame, group: list[str], order: list[str], parts: list[str]) -> DataFrame:
    """group and fingerprint, the digest of the digests of a tree's rows (of parts), one a line in order.

    Rows are sorted by Spark and digested as they come, so a tree is never held as a whole; the digest
    of a sequence has one order, so a tree's rows are in one task."""
    each = rows.select(*group, *order, F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256).alias("_d"))
    schema = StructType([*(each.schema[g] for g in group), StructField("fingerprint", StringType())])

    def run(batches):
        key, state = None, None
        for b in batches:
            out = []
            for *at, digest in zip(*(b.column(c).to_pylist() for c in [*group, "_d"])):
                if state is None or at != key:
                    if state is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = at, hashlib.sha256(digest.encode())
                else:
                    state.update(b"\n" + digest.encode())
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out))), schema=to_arrow_schema(schema))
        if state is not None:
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(schema.names, (*key, state.hexdigest()))}, schema=to_arrow_schema(schema))

    # the digest breaks ties of the order, so that equal tables have equal fingerprints
    return each.repartition(*group).sortWithinPartitions(*group, *order, "_d").select(*group, "_d").mapInArrow(run, schema)


def normalised_evidence(edges: DataFrame) -> DataFrame:
    """One row for each from_path, to_path, edge_type and type_only with the distinct lines and
    specifiers of its edges, in order. A line or specifier that is null is left out."""
    return edges.groupBy("from_path", "to_path", "edge_type", "type_only").agg(F.sort_array(F.collect_set("line")).alias("lines"), F.sort_array(F.collect_set("specifier")).alias("specifiers"))
