"""A training-data pipeline over documents: quality, exact copies, near copies, benchmark passages, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spatialcc.llm import decontaminate, exact_dedup, mixing, ngram_join, quality
from spatialcc.llm.common import documents, land, work_dir
from spatialcc.llm.queries import tokenizer


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.drop_low_quality(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return ngram_join.drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rate of each document in the mixture."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), tokenizer=tokenizer())


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", keep_first_copies),
    ("ngram_join", keep_one_of_near_copies),
    ("decontamination", keep_uncontaminated),
    ("mixing", weigh),
]

#: Classifiers and a fitted mixture have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    place, now = work_dir(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        now = land(stage(spark, now, sf_dir), f"{place}/{name}")
    return STAGES[-1][1](spark, now, sf_dir)
