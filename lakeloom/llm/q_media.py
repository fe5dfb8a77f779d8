"""op10: all documents stored as images in archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import media
from .common import table


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = media.store_payloads(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return media.read_archives(spark, folder).select(
        F.col("name").cast("long").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
