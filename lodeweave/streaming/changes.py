"""A stream of file changes kept as a snapshot.

The batch operators above are what the engine needs; this applies them to files
as they change, with Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "path string, hash string, ts timestamp, seq long"


def latest_changes(batch: DataFrame) -> DataFrame:
    """Return the last event of each path in a batch; a null hash means that the file went."""
    return batch.groupBy("path").agg(F.max_by(F.struct("hash", "ts", "seq"), F.struct("ts", "seq")).alias("r")).select("path", "r.*")


def apply_changes(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Return a snapshot ``(path, hash, ts, seq)`` after a batch; events older than what is known change nothing."""
    both = snapshot.select("path", "hash", "ts", "seq").unionByName(latest_changes(batch).select("path", "hash", "ts", "seq"))
    newest = both.groupBy("path").agg(F.max_by(F.struct("hash", "ts", "seq"), F.struct("ts", "seq")).alias("r"))
    return newest.select("path", "r.*")


def follow(spark: SparkSession, events: DataFrame, folder: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep a snapshot in ``folder`` up to date with a stream of events, a version for each batch.

    Version ``n`` is made from ``n - 1`` and batch ``n`` alone, so a batch that
    runs again after a failure writes the same version again.
    """

    def step(batch: DataFrame, number: int) -> None:
        old = spark.read.schema(EVENT).parquet(f"{folder}/v{number - 1}") if number else spark.createDataFrame([], EVENT)
        apply_changes(old, batch).write.mode("overwrite").parquet(f"{folder}/v{number}")
        if on_change:
            on_change(spark.read.parquet(f"{folder}/v{number}"), number)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_counts(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Return changes in each window of time; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("changes"), F.approx_count_distinct("path").alias("files")).select(F.col("window.start").alias("start"), "changes", "files")
