"""op8: likelihood of every document under a hidden Markov model of the training documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hmm
from .common import id_remainder, table


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = hmm.fit(docs, id_remainder("doc_id", 7) != 2)
    held_out = F.coalesce(id_remainder("doc_id", 7) == 2, F.lit(False))
    return model.score().select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
