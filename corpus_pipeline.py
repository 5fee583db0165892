"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestra.llm import decontaminate, near_duplicates, personal_data, quality_classifier, source_mixing
from attestra.llm.queries import WEIGHTS
from attestra.llm.shared_tables import packed, unpacked, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality_classifier.with_quality(packed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(scored.where("predicted = 1"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of least doc_id."""
    return near_duplicates.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that benchmark items have; those that are mostly such passages go."""
    return decontaminate.without_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return personal_data.masked(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their places in the mix of sources."""
    return source_mixing.mixed(docs, WEIGHTS)


STAGES = [("quality classifier", quality), ("near-duplicate removal", near_dedup), ("benchmark decontamination", decontamination), ("personal data", personal), ("source mixing", mixing)]
#: SQL can't express the classifier's training.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
