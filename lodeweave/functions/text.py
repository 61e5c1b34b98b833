"""Tokens and string sets, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Return the runs of ASCII letters, digits and underscores of a text in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def squeezed(text: Column) -> Column:
    """Return a text's tokens put together: what typo search compares."""
    return F.array_join(tokens(text), "")


def word_count(text: Column) -> Column:
    """Return the number of runs without blanks: the footprint of a text in a prompt."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")).cast("long")


def string_set(values: Column) -> Column:
    """Return strings trimmed, without empty ones and repeats, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")))


def distinct_in_order(values: Column) -> Column:
    """Return the values without repeats; first places stay."""
    return F.array_distinct(values)


def alias_map(aliases: Column) -> Column:
    """Return a map with trimmed keys and values and without empty ones; of keys that become equal the first stays."""
    entries = F.transform(F.map_entries(aliases), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    full = F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != ""))
    first = F.filter(full, lambda e, i: F.array_position(F.transform(full, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(first)


def shortened(values: Column, most: int) -> Column:
    """Return a sorted list as text, cut after ``most`` names with the number of those left out."""
    ordered = F.array_sort(values)
    rest = F.size(ordered) - most
    return F.when(rest > 0, F.concat(F.array_join(F.slice(ordered, 1, most), ", "), F.format_string(", ... (+%d more)", rest))).otherwise(F.array_join(ordered, ", "))


def source_line(content: Column, line: Column) -> Column:
    """Return line number ``line``, from 1, trimmed; empty where there is none."""
    return F.coalesce(F.trim(F.get(F.split(content, "\n"), (line - 1).cast("int")), F.lit(" \t\r")), F.lit(""))


def location(text: Column) -> Column:
    """Parse ``file:line`` at the last colon, with a line from 1 on, to a struct; null if it isn't one."""
    file, line = F.trim(F.regexp_extract(text, r"^(.+):([^:]+)$", 1)), F.trim(F.regexp_extract(text, r"^(.+):([^:]+)$", 2))
    number = F.when(line.rlike(r"^\+?[0-9]+$"), line.try_cast("int"))
    return F.when((file != "") & (number > 0), F.struct(file.alias("file"), number.alias("line")))


def tool_location(text: Column) -> Column:
    """Parse ``path:line:column`` at the head of a tool's output line to a struct; null if it isn't one."""
    pattern = r"^(.+?):(\d+):(\d+)(?:[-:\s].*)?$"
    part = [F.regexp_extract(F.trim(text), pattern, k) for k in (1, 2, 3)]
    return F.when(part[1] != "", F.struct(F.regexp_replace(part[0], r"\\", "/").alias("file"), part[1].try_cast("int").alias("line"), part[2].try_cast("int").alias("column")))
