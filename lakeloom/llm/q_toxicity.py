"""op6: toxicity of every document, learned from labelled rows outside the held-out fifth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .common import id_remainder, table


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), teaches=id_remainder("doc_id", 5) != 0)
    scored = model.apply(docs)
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, judged by a model learned from all labelled ones among them."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels")).keep(docs)
