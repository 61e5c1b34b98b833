"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled

TARGET_BYTES = 256 << 20
MIN_SHARDS = 8


#: Sums of bytes, their products with a number of shards, and quotients are exact up to 38 digits.
_EXACT = "decimal(38,0)"


def shard(docs: DataFrame, target_bytes: int = TARGET_BYTES, min_shards: int = MIN_SHARDS, order: str = "doc_id", text: str = "text") -> DataFrame:
    """Assign rows, in the order of ``order``, to contiguous shards of equal bytes; see :func:`shard_sizes`.

    Returns ``(doc_id, n_bytes, first_byte, shard_id)`` for each row. A null or
    empty text has 0 bytes (and goes where the line stands), a text of any length
    one row; texts themselves don't move. Other columns don't matter.
    """
    return shard_sizes(docs.select(F.col(order).alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes")), target_bytes, min_shards)


def shard_sizes(sizes: DataFrame, target_bytes: int = TARGET_BYTES, min_shards: int = MIN_SHARDS) -> DataFrame:
    """Assign rows of ``(doc_id, n_bytes)``, in order, to contiguous shards of equal bytes.

    Rows are range-partitioned by key and sorted, each partition's total is found
    (a few numbers for each partition), the totals before it are added to the
    sums within it, and the line of all bytes is cut at equal targets. There are
    ``ceil(total / target_bytes)`` shards, ``min_shards`` at least. A row goes to
    the shard in which its middle byte lies, so shards differ from the target by
    at most one row. Cuts are found in whole numbers, exact to 10^18 bytes.

    Null keys come first; rows of the same key are ordered by size; ties are
    alike, so it doesn't matter which is first, and they may lie in several
    partitions, whatever their number. Repeated rows all stay, an empty table
    gives an empty result.
    """
    key = F.col("doc_id").asc_nulls_first()
    ranged = sizes.repartitionByRange(key, F.col("n_bytes"), F.monotonically_increasing_id()).sortWithinPartitions(key, "n_bytes")
    kept = settled(ranged.withColumn("part", F.spark_partition_id()), "sizes")  # the partition's number is written, so later plans can't change it
    totals = kept.groupBy("part").agg(F.sum("n_bytes").alias("bytes"))
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = totals.select("part", (F.sum("bytes").over(line) - F.col("bytes")).alias("before"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy(key, "n_bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = kept.join(F.broadcast(before), "part")  # a row for each partition
    numbered = placed.withColumn("first_byte", F.sum("n_bytes").over(within) - F.col("n_bytes") + F.col("before"))
    shards = F.greatest(F.lit(min_shards).cast("long"), F.expr(f"(total + {target_bytes - 1}L) div {target_bytes}L"))
    middle = f"cast(cast(first_byte as {_EXACT}) * 2 + n_bytes as decimal(20,0)) * cast(shards as decimal(12,0)) div cast(cast(total as {_EXACT}) * 2 as decimal(20,0))"
    cut = F.when(F.col("total") == 0, F.lit(0)).otherwise(F.least(F.col("shards") - 1, F.expr(middle)))
    return numbered.withColumn("shards", shards).select("doc_id", "n_bytes", "first_byte", cut.cast("int").alias("shard_id"))


ORACLE = f"""
WITH s AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
t AS (SELECT CAST(coalesce(sum(n_bytes), 0) AS HUGEINT) AS total FROM s), n AS (SELECT total, greatest({MIN_SHARDS}, CAST(ceil(total / {TARGET_BYTES}) AS HUGEINT)) AS shards FROM t),
cuts AS (SELECT k AS shard_id, (k * 2 * total + shards - 1) // shards AS cut FROM n, range(CAST(shards AS BIGINT)) r(k)),
l AS (SELECT doc_id, n_bytes, CAST(sum(n_bytes) OVER (ORDER BY doc_id NULLS FIRST, n_bytes ROWS UNBOUNDED PRECEDING) - n_bytes AS BIGINT) AS first_byte FROM s),
m AS (SELECT *, CAST(first_byte AS HUGEINT) * 2 + n_bytes AS middle FROM l)
SELECT doc_id, n_bytes, first_byte, CAST(CASE WHEN total = 0 THEN 0 ELSE (SELECT max(shard_id) FROM cuts WHERE cut <= middle) END AS INTEGER) AS shard_id FROM m, n
"""
