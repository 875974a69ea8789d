"""The corpus pipeline: quality, near duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import corpus
from tokenloom.llm.common import materialize, table

STAGES = [
    ("quality", corpus.quality_stage),
    ("near_dedup", corpus.near_dedup_stage),
    ("suffix_dedup", corpus.repeats_stage),
    ("pii", corpus.pii_stage),
    ("packing", corpus.packing_stage),
]
#: A fitted classifier, sketches and dynamic programming: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
