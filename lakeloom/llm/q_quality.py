"""op4: statistics of every document and the verdict of base rule and decision list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .common import stored, table


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    statistics = stored(quality.text_statistics(documents.select("doc_id", "text")).drop("text"), "quality")
    rows = stored(quality.labelled(statistics, labels), "quality-fit")
    judged = quality.judge(statistics, quality.learn_list(rows))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "reason")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the list rejects."""
    # The whole row travels in a struct, so that no column of docs meets a column of the statistics,
    # and rows are written with their statistics, so that these are computed once.
    packed = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    statistics = stored(quality.text_statistics(packed, "_text").drop("_text"), "quality")
    known = quality.labelled(statistics.withColumn("doc_id", F.col("_row.doc_id")), table(spark, sf_dir, "labels"))
    rules = quality.learn_list(stored(known, "quality-fit"))
    return quality.judge(statistics, rules).filter("kept").select("_row.*")
