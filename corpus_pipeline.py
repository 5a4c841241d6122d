"""The corpus pipeline: each stage reads what the one before has written.

Quality rules drop documents and cut recurring lines, near duplicates shrink to one document, documents
with test items go, secrets are masked, and sources are mixed to target weights. All stages but the last
return the columns of documents, whatever these are; texts of any length pass; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from factloom.llm import contamination, line_quality, mixing, secret_scan, simhash
from factloom.llm.common import shared_dir
from pyspark.sql import DataFrame, SparkSession


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; kept ones lose the lines above the limits.

    Null, empty and short texts are rejected; repeated rows stay or go together; a null source is a host of its own.
    """
    return line_quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, the one with the smallest id.

    Of repeated rows one stays; a null id comes after all others; texts without a word are one group.
    """
    return simhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go, and with them rows that repeat them. Null and empty texts and items match nothing."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays. Null texts stay null, repeated rows are masked alike."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their targets.

    A null source is a source of its own; rows with equal ids share their coin; texts without a word count nothing.
    """
    return mixing.emit(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("secret scans", secrets), ("mixing", mixture)]

#: Fingerprints of mixed hashes can't be expressed in SQL; tests hold the stages against brute force and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
