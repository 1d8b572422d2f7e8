"""Corpus preparation: quality, exact and near duplicates, benchmark passages, source mix.

Every stage is (spark, docs, sf_dir) -> DataFrame. The caller writes what a stage returns as Parquet
and hands it, read again, to the next; ``run`` does so in the shared work folder. All stages but the
last return the columns they were given. None of this can be said in SQL as a whole, since the first
stage trains a model; the stages are tested against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skimdex.llm import decontaminate, exact_dedup, mixing, near_texts, quality
from skimdex.llm.common import stored
from skimdex.session import configure


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained classifier accepts."""
    configure(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    configure(spark)
    return exact_dedup.drop_exact(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of texts whose five-word shingles are alike to 0.8 or more."""
    configure(spark)
    return near_texts.drop_near(docs, whole=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    configure(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to target weights in random order, with ``copy`` and ``shuffle_key``."""
    configure(spark)
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_deduplication", exact_deduplication),
    ("near_deduplication", near_deduplication),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
