"""Identities and hashes, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("func", "method", "class", "struct", "interface", "module", "const", "var")


def symbol_id(file: Column, line: Column, kind: Column, name: Column, signature: Column) -> Column:
    """Return ``file|line|kind|name``, with eight hex digits of the signature's SHA-1 where there is a signature."""
    plain = F.concat_ws("|", file, line.cast("string"), kind, name)
    digest = F.substring(F.sha1(signature.cast("binary")), 1, 8)
    return F.when(F.coalesce(signature, F.lit("")) == "", plain).otherwise(F.concat_ws("|", plain, digest))


def id_file(symbol: Column) -> Column:
    """Return the file part of an id; null if it has fewer than four parts."""
    parts = F.split(symbol, r"\|")
    return F.when(F.size(parts) >= 4, F.get(parts, F.lit(0)))


def id_name(symbol: Column) -> Column:
    """Return the name part of an id; null if it has fewer than four parts."""
    parts = F.split(symbol, r"\|")
    return F.when(F.size(parts) >= 4, F.get(parts, F.lit(3)))


def content_hash(content: Column) -> Column:
    """Return the first 16 hex digits of the SHA-256 of content; null counts as empty."""
    return F.substring(F.sha2(F.coalesce(content.cast("binary"), F.lit(b"")), 256), 1, 16)


def cache_key(symbol: Column, file_hash: Column, prompt: Column, profile: Column, model: Column) -> Column:
    """Return the key of an annotation: a hash of five trimmed fields."""
    seed = F.concat_ws("|", *(F.trim(F.coalesce(c.cast("string"), F.lit(""))) for c in (symbol, file_hash, prompt, profile, model)))
    return F.concat(F.lit("cache-v1-"), F.substring(F.sha2(seed.cast("binary"), 256), 1, 16))


def kind_text(ordinal: Column) -> Column:
    """Return the name of a symbol kind's number, from 0; others are unknown."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.coalesce(F.get(names, ordinal), F.lit("unknown"))


def filled_id(symbol: Column, file: Column, line: Column, kind: Column, name: Column, signature: Column) -> Column:
    """Return ids, made where they're missing or empty."""
    return F.coalesce(F.nullif(symbol, F.lit("")), symbol_id(file, line, kind, name, signature))
