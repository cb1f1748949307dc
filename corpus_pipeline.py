"""A corpus pipeline of five stages. Each takes what the one before kept."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarp.llm import decontamination, line_dedup, mixing, quality, simhash
from tidewarp.llm.common import WORD, broadcast_if_small, materialized, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the others stay as they are. Null and empty texts are
    scored like any other; without labels on both sides all stay; repeated rows stay as often as they
    come."""
    return quality.quality(docs, table(spark, sf_dir, "labels"), only=True)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks go from the later document, and documents of which no word is left that had some. Null
    and empty texts, and rows without an id, stay as they are. n_chars follows the text."""
    out = line_dedup.line_dedup(docs, column="__deleted")
    return out.filter((F.size("__deleted") == 0) | F.col("text").rlike(WORD)).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id. Documents without words
    are one group; rows without an id stay; rows that repeat an id stay or go together."""
    gone = materialized(simhash.near_copies(docs).select(F.col("doc_id").alias("__id")).distinct(), "near-copies")
    return docs.join(broadcast_if_small(gone), F.col("doc_id") == F.col("__id"), "left_anti")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; null and empty texts leak none. Without items all stay."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with size, source_size, target and taken, which replace columns of those
    names. Documents without words, or of which the mix takes none, are not in it."""
    return mixing.mixed(docs, quality=table(spark, sf_dir, "labels")).filter("taken > 0")


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmarks),
    ("mixing", mixed_sources),
]
#: Fitted models and fingerprints are beyond SQL: tests/llm/test_pipeline.py has the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
