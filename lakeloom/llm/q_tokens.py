"""op5: token counts of all documents, scanned from flat token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import scratch, stored, table
from .tokenfiles import scan_token_files, write_token_files
from .tokens import tokenizer_path

END_ID = 50256


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = stored(write_token_files(docs, folder, "doc_id", "text", tokenizer_path("byte_bpe_50k.json"), END_ID), "token-names")
    found = scan_token_files(spark, folder, END_ID)
    # Both sides grow with the corpus, however small they compress, so neither is broadcast.
    return names.hint("merge").join(found, ["file", "number"]).selectExpr("id AS doc_id", "n_tokens")
