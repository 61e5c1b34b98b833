"""Tables of the data folder, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Return a table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Temporary folders of applications on one machine that have no shared folder.
_OWN: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """Return the folder of this application's intermediates in the shared folder that the cluster names.

    Only a session whose driver and tasks are one machine may do without: it
    gets a temporary folder. Elsewhere that would be a folder that other
    machines don't see, so it's an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if spark.sparkContext.applicationId not in _OWN:  # the setting itself can't be changed in a session
            _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodeweave-")
        root = _OWN[spark.sparkContext.applicationId]
    return f"{root.rstrip('/')}/lodeweave/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, what: str) -> str:
    """Return the name of a new folder for intermediates, which all executors see."""
    return f"{_root(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediates of this application; results that weren't written elsewhere can't be read any more."""
    discard(spark, _root(spark))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Rounds:
    """Tables that a fixpoint loop writes, one a round, so that lineage ends with each."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.count = spark, shared_dir(spark, what), 0

    def settle(self, df: DataFrame) -> DataFrame:
        """Write a round's table and return it as read back."""
        path = f"{self.root}/{self.count:04d}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, back: int) -> None:
        """Delete the table written ``back`` rounds ago, which nothing reads any more."""
        if self.count > back:
            discard(self.spark, f"{self.root}/{self.count - 1 - back:04d}")

    def all(self, schema) -> DataFrame:
        """Return the tables of all rounds together."""
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{i:04d}" for i in range(self.count)])


def settled(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    return Rounds(df.sparkSession, what).settle(df)


def spread(df: DataFrame, column: str) -> DataFrame:
    """Return a table dealt over as many tasks as Spark shuffles to.

    For rows that take far longer to work on than to read: a small file may
    hold very many, and it would be few tasks that work on them.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)
