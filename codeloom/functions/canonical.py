"""Canonical JSON, its digest, and base64url."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column | str) -> Column:
    """An object with its keys in code-point order and nulls kept."""
    named = (((F.col(c) if isinstance(c, str) else c).alias(k)) for k, c in sorted(fields.items()))
    return F.to_json(F.struct(*named), {"ignoreNullFields": "false"})


def canonical_key(**fields: Column | str) -> Column:
    """The SHA-256 of canonical_json, in hex: the identity of a row by its meaning."""
    return F.sha2(canonical_json(**fields), 256)


def base64url(data: Column) -> Column:
    """Base64 in the alphabet for URLs, without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    """The bytes; null for what is not base64url."""
    padded = F.rpad(F.translate(text, "-_", "+/"), (F.ceil(F.length(text) / 4) * 4).cast("int"), "=")
    return F.when(text.rlike("^[A-Za-z0-9_-]+$"), F.try_to_binary(padded, F.lit("base64")))
