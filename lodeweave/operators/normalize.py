"""What extractors give, put in order: call sites and legacy forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALL = "struct<name: string, qualifier: string, receiver: string, arity: int, line: int, raw: string>"
_KEY = ("name", "qualifier", "receiver", "arity", "line")
_ORDER = ("line", "qualifier", "name", "receiver", "raw")


def call_sites(calls: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Return trimmed calls without nameless ones and repeats, of which the first stays, with ``place`` in their order within ``by``."""
    texts = ("name", "qualifier", "receiver", "raw")
    clean = calls.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in texts}).where("name <> ''")
    first = clean.withColumn("__first", F.row_number().over(Window.partitionBy(*by, *_KEY).orderBy(pos))).where("__first = 1").drop("__first")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*_ORDER)))


def call_list(calls: Column) -> Column:
    """Return an array of call structs put in order in its own row: as :func:`call_sites`, without a shuffle."""
    trimmed = F.transform(calls, lambda c: F.struct(*[(F.trim(F.coalesce(c[n], F.lit(""))) if n not in ("arity", "line") else F.coalesce(c[n], F.lit(0))).alias(n) for n in ("name", "qualifier", "receiver", "arity", "line", "raw")]))
    named = F.filter(trimmed, lambda c: c["name"] != "")
    key = lambda c: F.struct(*[c[n] for n in _KEY])
    first = F.filter(named, lambda c, i: F.array_position(F.transform(named, key), key(c)) == i + 1)
    order = lambda c: F.struct(*[c[n].alias(n) for n in _ORDER], c["arity"].alias("arity"))
    return F.transform(F.array_sort(F.transform(first, order)), lambda c: F.struct(*[c[n].alias(n) for n in ("name", "qualifier", "receiver", "arity", "line", "raw")]))


def decoded_calls(json: Column) -> Column:
    """Return calls from JSON: a list of objects, or, as older files have it, of names."""
    names = F.transform(F.from_json(json, "array<string>"), lambda n: F.struct(n.alias("name"), F.lit("").alias("qualifier"), F.lit("").alias("receiver"), F.lit(0).alias("arity"), F.lit(0).alias("line"), F.lit("").alias("raw")))
    plain = F.trim(json).rlike(r'^\[\s*"')
    return F.when(plain, names).otherwise(F.coalesce(F.from_json(json, f"array<{CALL}>"), F.array().cast(f"array<{CALL}>")))
