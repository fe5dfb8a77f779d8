"""op2: a sampled segmentation of every document, and its decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pieces import decode, encode
from .tokens import tokenizer_path


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    both = decode(coded, path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.octet_length("decoded").cast("long").alias("n_bytes"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )
