"""The corpus pipeline: quality rules, exact and near deduplication, mixing, packing. Each stage works on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cueline.llm import exact, mixing, near, packing, quality
from cueline.llm.common import discarded, shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected rows go, by id, text, language and source. Null and empty texts are rejected; a repeated or null id covers for no other row. No rows in, no rows out."""
    return quality.kept_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for white space one stays (the least id). Null text counts as empty; rows under one id with different texts are different rows."""
    return exact.kept_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) one stays (the least id). Texts without words are linked with nothing and stay."""
    return near.kept_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. Null sources are a source; rows that repeat id, text and source share what they are taken."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences: other columns than those of documents. Null and empty texts have size 1 (their separator); repeated rows are pieces of their own."""
    return packing.packed_sequences(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/cueline/{uuid.uuid4().hex}"
    before = None  # the table of the stage before, which nothing reads once the next one is written
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before is not None:
            discarded(before)
        before = docs = spark.read.parquet(f"{folder}/{name}")
    return docs
