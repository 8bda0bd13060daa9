"""Corpus pipeline: documents without toxic ones, repeated lines, near-duplicates and benchmark passages, mixed by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from custodia.llm import stages
from custodia.session import scratch_folder

STAGES = [
    ("toxicity", stages.without_toxic),
    ("line_dedup", stages.without_repeated_lines),
    ("near_duplicates", stages.without_near_duplicates),
    ("decontamination", stages.without_benchmark),
    ("mixing", stages.mixed_sources),
]
#: Trained scores, signatures and orders by hash have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
