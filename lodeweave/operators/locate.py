"""Nearest definitions: as-of joins by file and line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(queries: DataFrame, symbols: DataFrame, by: str = "file", at: str = "line", key: str = "id") -> DataFrame:
    """Return ``queries`` with ``found`` and ``found_at``: the nearest symbol at or before their place in the same group, or null.

    Of symbols at the same place the one with the least key is found. Both sides
    are sorted together once and the last symbol is carried on, so no pair of
    rows is made and the work is that of a sort.
    """
    names = [c for c in queries.columns if c not in (by, at)]
    left = queries.select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(None).cast(symbols.schema[key].dataType).alias("__key"), F.struct(*names, F.lit(True).alias("__is")).alias("__row"))
    right = symbols.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.col(key).alias("__key"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"))
    line = Window.partitionBy("__by").orderBy(F.col("__at"), F.col("__row").isNotNull(), F.desc("__key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.last(F.when(F.col("__row").isNull(), F.struct("__key", "__at")), ignorenulls=True).over(line)
    both = left.unionByName(right).withColumn("__hit", hit).where("__row is not null")
    known = F.col("__by").isNotNull() & F.col("__at").isNotNull()
    return both.select(F.col("__by").alias(by), F.col("__at").alias(at), *[F.col(f"__row.{n}").alias(n) for n in names], F.when(known, F.col("__hit.__key")).alias("found"), F.when(known, F.col("__hit.__at")).alias("found_at"))


def references(locations: DataFrame, symbols: DataFrame, own: str, edges: DataFrame) -> DataFrame:
    """Return ``(id, confidence)`` of the symbols in which a tool's ``locations(file, line)`` lie, without the symbol ``own``."""
    found = as_of(locations.select("file", "line").distinct(), symbols).where(F.col("found").isNotNull() & (F.col("found") != own)).select(F.col("found").alias("id")).distinct()
    into = edges.where(F.col("dst") == own).select(F.col("src").alias("id"), "confidence")
    return found.join(into, "id", "left").select("id", F.coalesce("confidence", F.lit("")).alias("confidence"))


def definition(locations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Return the id of the symbol at the first of ``locations(pos, file, line)`` that lies in one; no row if none does."""
    return as_of(locations, symbols).where("found is not null").orderBy("pos").limit(1).select(F.col("found").alias("id"))
