"""Node addresses, fingerprints and folders of paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_node(path: Column | str) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_node(path: Column | str, name: Column | str) -> Column:
    return F.concat(F.lit("symbol:"), path, F.lit("#"), name)


def node_kind(node: Column) -> Column:
    """file, symbol or folder; null for any other prefix, an empty remainder, or a symbol without #."""
    kind, rest = F.substring_index(node, ":", 1), F.regexp_extract(node, "^[^:]*:([\\s\\S]*)$", 1)
    named = (kind != "symbol") | rest.contains("#")
    return F.when(kind.isin("file", "symbol", "folder") & (rest != "") & named, kind)


def owning_path(node: Column) -> Column:
    """The path of a file or folder, or of a symbol's file: what stands before the last #."""
    rest = F.regexp_extract(node, "^[^:]*:([\\s\\S]*)$", 1)
    return F.when(node_kind(node) == "symbol", F.regexp_extract(rest, "^([\\s\\S]*)#", 1)).when(node_kind(node).isNotNull(), rest)


def fingerprint(*parts: Column | str) -> Column:
    """32 hex digits of the SHA-256 of the parts joined by NUL; a null part is empty."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\0", *texts), 256), 1, 32)


def folder_of(path: Column) -> Column:
    """The first two directories of a path, or "." for a file at the root."""
    dirs = F.slice(F.split(path, "/"), 1, F.least(F.lit(2), F.size(F.split(path, "/")) - 1))
    return F.when(F.size(dirs) == 0, ".").otherwise(F.array_join(dirs, "/"))


def ancestors(path: Column) -> Column:
    """All folders above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def under(path: Column, folder: str) -> Column:
    """Whether a path is the folder or lies in it."""
    return (path == folder) | path.startswith(folder + "/")


def package_of(specifier: Column) -> Column:
    """The package a specifier names: one segment, or two if it is scoped."""
    return F.regexp_extract(specifier, "^(@[^/]+/[^/]+|[^/]+)", 1)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)
