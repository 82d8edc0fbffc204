"""Digests of sets and of folder trees that gather nothing: parts of digests are summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.tables import stored


def set_digest(digest: str) -> Column:
    """An aggregate: a digest of the rows' SHA-256 digests (hexadecimal) that does not depend on their
    order, but does on how often each comes.

    Eight lanes of 32 bits are summed each by itself and digested with the number of rows, so rows are
    added up before they are shuffled. Good for 2,000,000,000 rows, beyond which a sum is an error.
    """
    lanes = [F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")).cast("string") for k in range(8)]
    return F.sha2(F.concat_ws(":", F.count(digest).cast("string"), *lanes), 256)


def folder_digests(files: DataFrame) -> DataFrame:
    """folder ("" for the root), digest and files (how many lie below) of every folder of a tree.

    files: path and digest, SHA-256 of what identifies the content. A folder's digest is that of the set
    of its entries, each a name, a kind and a digest, so it changes with anything below it and is the
    same wherever the folder lies. Folders are folded level by level from the deepest; a level is one
    aggregation, whatever the size of a folder. An empty table has no folders.
    """
    depth = F.size(F.split("path", "/"))
    entries = stored(files.select("path", depth.alias("depth"), F.lit("file").alias("kind"), "digest", F.lit(1).cast("long").alias("files")), "tree-entries")
    deepest = entries.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    folders = None
    level = entries.filter(F.col("depth") == deepest)
    for d in range(deepest, 0, -1):
        name, parent = F.regexp_extract("path", "([^/]*)$", 1), F.regexp_replace("path", "/?[^/]*$", "")
        entry = F.sha2(F.concat_ws("\u0000", name, "kind", "digest"), 256)
        folded = level.select(parent.alias("path"), entry.alias("entry"), "files").groupBy("path").agg(set_digest("entry").alias("digest"), F.sum("files").alias("files"))
        made = stored(folded.select("path", F.lit(d - 1).alias("depth"), F.lit("folder").alias("kind"), "digest", "files"), "tree-folders")
        folders = made if folders is None else folders.unionByName(made)
        level = made.unionByName(entries.filter(F.col("depth") == d - 1))
    if folders is None:
        folders = entries
    return folders.select(F.col("path").alias("folder"), "digest", "files")


def changed_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """folder and change (added, removed or changed) of the folders whose digests differ between two
    results of folder_digests."""
    met = before.select("folder", F.col("digest").alias("b")).join(after.select("folder", F.col("digest").alias("a")), "folder", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return met.select("folder", change.alias("change")).filter("change IS NOT NULL")


def member_sets(members: DataFrame, group: str, member: str) -> DataFrame:
    """group, members (how many), first (the least) and identity, a digest of the set of members, by
    which a group is told whatever it is called and in whatever order it comes."""
    return members.select(group, member, F.sha2(F.col(member).cast("string"), 256).alias("_d")).groupBy(group).agg(F.count("*").alias("members"), F.min(member).alias("first"), set_digest("_d").alias("identity"))
