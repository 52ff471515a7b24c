"""The corpus pipeline: from `documents` to a training mix.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns the mix: doc_id, source, size,
source_size, target and taken (words) of the documents that it takes words from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oeuvre.llm import jaccard, mixing, quality, secrets, templates
from oeuvre.llm.shared import staged


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item leaked into go."""
    return templates.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), inside=True)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a secret go."""
    return secrets.without_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("taken > 0")


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
]

#: The first stage has no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else staged(docs, "documents"), sf_dir)
    return docs
