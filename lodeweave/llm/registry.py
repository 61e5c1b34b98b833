"""Queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, classifier, linededup, packing, rules, sharding, simhash, substrings, warc
from .shared import read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents with a model fitted on labelled ones."""
    docs = read(spark, sf_dir, "documents")
    return classifier.classify(docs, classifier.train(docs, read(spark, sf_dir, "labels")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents and decode the tokens."""
    return bpe.decode(bpe.encode(read(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return the passages of all documents that occur earlier, one row each."""
    found = substrings.repeated_spans(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return the ten nearest neighbours, among all embeddings, of those whose id is divisible by 20."""
    return ann.neighbours(read(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages; return the index."""
    return warc.write_warc(read(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return the groups of near duplicates among all documents, and how many links each has."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return all documents' texts without later repeated runs of lines."""
    return linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assign all documents to shards."""
    return sharding.shard(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all documents."""
    return rules.judge(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_bpe": op2_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_neighbours": op4_neighbours,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_sharding": op9_sharding,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES: dict[str, str] = {"op3_substring_dedup": substrings.ORACLE, "op8_line_dedup": linededup.ORACLE, "op9_sharding": sharding.ORACLE, "op10_quality_rules": rules.ORACLE}
