"""The corpus pipeline: raw documents to packed training sequences.

Five stages, each of which calls one operator on all that its predecessor kept.
``run`` writes what each returns as Parquet in the shared folder and reads it
again for the next; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import classifier, linededup, packing, simhash, substrings
from lodeweave.llm.shared import read, settled


def _counted(docs: DataFrame) -> DataFrame:
    """Return rows whose ``n_chars``, where there is one, fits the text again."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, fitted on labelled ones among them, rejects; null and empty texts go too."""
    return classifier.keep_good(docs, classifier.train(docs, read(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete runs of lines that occur earlier; every document keeps its row."""
    return _counted(linededup.dedup_lines(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates; texts without a word stay, and texts with the same key are compared like documents."""
    return simhash.dedup_texts(docs)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete passages of 50 words or more that occur earlier; every document keeps its row."""
    return _counted(substrings.dedup_passages(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack documents into sequences of several lengths; those without text are in none."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("passage dedup", dedup_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return the sequences packed from the documents of a folder."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = settled(stage(spark, docs, sf_dir), f"stage{k + 1}")
    return docs


#: SQL can't express the classifier, SimHash groups and best fit; tests hold each stage against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
