"""Snapshots of files: differences, merges, and what a change affects.

A snapshot is ``(path, hash, deps ARRAY<STRING>, ...)``, one row for each path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.graph import depths


def difference(old: DataFrame, current: DataFrame, stale: Column | None = None) -> DataFrame:
    """Return ``(path, change)``: paths that are new, have another hash, or are gone; ``stale`` marks old rows to take as changed."""
    mark = F.lit(False) if stale is None else F.coalesce(stale, F.lit(False))
    a = old.select("path", F.col("hash").alias("old_hash"), mark.alias("stale"), F.lit(True).alias("had"))
    b = current.select("path", F.col("hash").alias("new_hash"), F.lit(True).alias("has"))
    change = F.when(F.col("has").isNull(), "deleted").when(F.col("had").isNull(), "added").when(F.col("stale") | ~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def merge(old: DataFrame, parsed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Return the snapshot with parsed rows in place of old ones, without their dependencies, and without deleted paths."""
    kept = old.join(parsed.select("path").unionByName(deleted.select("path")).distinct(), "path", "left_anti")
    return kept.select(old.columns).unionByName(parsed.withColumn("deps", F.array().cast("array<string>")).select(old.columns))


def refreshed(snapshot: DataFrame, dependencies: DataFrame, paths: DataFrame) -> DataFrame:
    """Return the snapshot in which the given paths have the dependencies of ``dependencies(src_file, dst_file)``."""
    own = dependencies.groupBy(F.col("src_file").alias("path")).agg(F.sort_array(F.collect_set("dst_file")).alias("found"))
    fresh = paths.select("path", F.lit(True).alias("fresh")).distinct()
    deps = F.when(F.col("fresh"), F.coalesce("found", F.array().cast("array<string>"))).otherwise(F.col("deps"))
    return snapshot.join(fresh, "path", "left").join(own, "path", "left").withColumn("deps", deps).select(snapshot.columns)


def rewritten(before: DataFrame, after: DataFrame) -> DataFrame:
    """Return one row ``(rewritten)``: paths of either side whose hashes differ; a missing one is empty."""
    a, b = before.select("path", F.col("hash").alias("a")), after.select("path", F.col("hash").alias("b"))
    differs = F.coalesce("a", F.lit("")) != F.coalesce("b", F.lit(""))
    return a.join(b, "path", "full").agg(F.count_if(differs).alias("rewritten"))


def _reversed(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(F.explode("deps").alias("src"), F.col("path").alias("dst"))


def closure(snapshot: DataFrame, seeds: DataFrame) -> DataFrame:
    """Return ``(path)``: the seeds and all that depend on them, over any number of steps."""
    return depths(_reversed(snapshot), seeds.select(F.col("path").alias("id"))).select(F.col("id").alias("path"))


def impact(snapshot: DataFrame, symbols: DataFrame, calls: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Return ``(path, reasons)``: what a change affects, and why, with sorted reasons.

    Affected are seeds, all that depend on them over any number of steps (for
    each file that it depends on there is a reason), and then, one step only,
    files with a ``calls(path, sym_pos, call_pos, name)`` of a name that
    ``symbols(path, name)`` has in a changed file; the first such call is named.
    """
    seeds = changed.select("path", F.lit("changed").alias("reason")).unionByName(deleted.select("path", F.lit("deleted").alias("reason"))).distinct()
    links = _reversed(snapshot)
    reached = depths(links, seeds.select(F.col("path").alias("id"))).select("id")
    through = links.join(reached.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("path"), F.concat(F.lit("depends on "), "src").alias("reason"))
    names = symbols.join(changed.select("path"), "path", "left_semi").where("name <> ''").select("name").distinct()
    calling = calls.join(reached.withColumnRenamed("id", "path"), "path", "left_anti").join(names, "name", "left_semi")
    called = calling.groupBy("path").agg(F.concat(F.lit("calls changed symbol "), F.min_by("name", F.struct("sym_pos", "call_pos"))).alias("reason"))
    return seeds.unionByName(through).unionByName(called).groupBy("path").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
