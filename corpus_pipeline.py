"""The corpus pipeline: documents in, packed sequences out.

Each stage gets what its predecessor kept, and all but the last return the columns of documents, extra ones included. Null texts are
empty and leave with the first stage; repeated rows are near-duplicates of each other; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import decontaminate, packing, pii, quality_classifier, simhash
from factorloom.llm.common import cut, tokenizer_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling selects."""
    return quality_classifier.keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash component, the one with the smallest doc_id (null counts as the smallest)."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a benchmark item; others with the same doc_id stay."""
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, one row per piece."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", classify),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", drop_leaks),
    ("pii", redact),
    ("packing", pack),
]
#: SQL can't express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if i + 1 < len(STAGES):
            rows = cut(rows)
    return rows
