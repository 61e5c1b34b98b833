"""Annotations of symbols: selection, validation, and an upsert by key.

A record has ``symbol_id, profile, cache_key, generated_at, updated_at`` and any
further columns; times are text of one format and compared as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.storage import spread

LEVELS = ("low", "medium", "high")


def normalized_selector(value: Column) -> Column:
    """Return a selector trimmed, with slashes, without a leading ``./`` and in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(value), r"\\", "/"), r"^\./", ""))


def _texts(file: Column, symbol: Column, name: Column, line: Column) -> list[Column]:
    """Return what selectors are compared with: the path, the plain name, and the texts that must be equal."""
    path, plain = normalized_selector(file), F.lower(F.trim(name))
    at = F.concat_ws(":", path, line.cast("string"))
    return [path, plain, F.array(path, normalized_selector(symbol), plain, F.concat_ws(":", path, plain), at, F.concat_ws(":", at, plain))]


def _means(want: Column, path: Column, plain: Column, exact: Column) -> Column:
    return (want == "") | F.array_contains(exact, want) | F.startswith(path, want) | F.endswith(path, want) | F.contains(plain, want)


def matches(selector: Column, file: Column, symbol: Column, name: Column, line: Column) -> Column:
    """Tell whether a selector means a symbol: by file, id, name, or these with a line; by the file's head or end; or by a part of the name."""
    return _means(normalized_selector(selector), *_texts(file, symbol, name, line))


def selected(symbols: DataFrame, selectors: DataFrame) -> DataFrame:
    """Return ``(selector, id)`` of the symbols that each selector means.

    Texts are normalized once a symbol and once a selector, not once a pair. Of
    selectors there are few, which every task gets.
    """
    path, plain, exact = _texts(F.col("file"), F.col("id"), F.col("name"), F.col("line"))
    known = spread(symbols.select("id", "file", "name", "line"), "id").select("id", path.alias("path"), plain.alias("plain"), exact.alias("exact"))
    asked = selectors.select("selector", normalized_selector(F.col("selector")).alias("want"))
    return known.crossJoin(F.broadcast(asked)).where(_means(*(F.col(c) for c in ("want", "path", "plain", "exact")))).select("selector", "id")


def valid(summary: Column, purpose: Column, effects: Column, confidence: Column) -> Column:
    """Tell whether an annotation has its three texts and a known confidence."""
    some = [F.trim(F.coalesce(c, F.lit(""))) != "" for c in (summary, purpose, effects)]
    return some[0] & some[1] & some[2] & F.coalesce(confidence.isin(*LEVELS), F.lit(False))


def latest(records: DataFrame, keys: list[str], time: Column, order: str) -> DataFrame:
    """Return the last record for each key by ``time``; of records of the same time the later in ``order``."""
    place = Window.partitionBy(*keys).orderBy(time.desc(), F.desc(order))
    return records.withColumn("__place", F.row_number().over(place)).where("__place = 1").drop("__place")


def loaded(records: DataFrame, line: str = "line") -> DataFrame:
    """Return the records of a cache: for each key the last by ``updated_at``, or ``generated_at`` where that is empty."""
    return latest(records, ["cache_key"], F.coalesce(F.nullif("updated_at", F.lit("")), F.col("generated_at")), line)


def upsert(cache: DataFrame, incoming: DataFrame) -> DataFrame:
    """Return the cache with incoming records, one for each symbol and profile.

    An incoming record with a known key keeps the time at which that was first
    made; all other records of its symbol and profile go.
    """
    first = cache.select("cache_key", F.col("generated_at").alias("__first"))
    fresh = incoming.join(first, "cache_key", "left").withColumn("generated_at", F.coalesce(F.nullif("__first", F.lit("")), "generated_at")).select(cache.columns)
    kept = cache.join(incoming.select("symbol_id", "profile").distinct(), ["symbol_id", "profile"], "left_anti").join(incoming.select("cache_key"), "cache_key", "left_anti")
    return kept.select(cache.columns).unionByName(fresh)


def records(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Return a nested record to fill in for each symbol: what it is, its line of source, imports, calls and callers."""
    from lodeweave.functions.text import source_line
    from lodeweave.operators.graph import adjacency

    near = adjacency(edges)
    empty = F.array().cast("array<string>")
    about = files.select(F.col("path").alias("file"), "language", "hash", "imports", "content")
    joined = symbols.join(about, "file").join(near, "id", "left")
    return joined.select(
        F.col("id").alias("symbol_id"),
        F.col("hash").alias("file_hash"),
        F.lit("pending").alias("status"),
        F.struct(
            F.struct("id", "name", "kind", "signature", F.col("file").alias("path"), "language", "line").alias("symbol"),
            F.struct(F.col("line").alias("start_line"), F.col("line").alias("end_line"), source_line(F.col("content"), F.col("line")).alias("body")).alias("source"),
            "imports",
            F.coalesce("out_edges", empty).alias("calls"),
            F.coalesce("in_edges", empty).alias("called_by"),
        ).alias("input"),
    )
