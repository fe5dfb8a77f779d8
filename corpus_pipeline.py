"""The corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Each stage reads what the one before it kept, written as Parquet. The first three return the
columns of documents, the last the pieces of all documents left, with their ids and places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import q_neardup, q_packing, q_quality, q_toxicity
from lakeloom.llm.common import stored, table

STAGES = [
    ("quality rules", q_quality.stage),
    ("toxicity", q_toxicity.stage),
    ("near-duplicates", q_neardup.stage),
    ("best-fit packing", q_packing.stage),
]

# Stages learn from labels and call a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
