"""A training-data pipeline over ``documents``: language, lines, near duplicates, mixing, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.lineage import owned, remove, shared_dir
from quarry.llm import stages

STAGES = [
    ("language_id", stages.known_language),
    ("line_dedup", stages.fresh_lines),
    ("ngram_join", stages.one_of_each),
    ("source_mix", stages.mixed_sources),
    ("byte_bpe", stages.token_ids),
]

#: SQL expresses neither the language model nor the tokens; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again by the next.

    What a stage has cut goes when it is written, and its own table when the next one is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at, before = f"{shared_dir(spark)}/quarry/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with owned(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{at}/{name}")
        if before:
            remove(spark, before)
        before = f"{at}/{name}"
        docs = spark.read.parquet(before)
    return docs
