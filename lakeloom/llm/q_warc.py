"""op7: all pages through ARC and WARC archives and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .common import table


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id", "url", "html")
    return warc.read_warcs(spark, folder).select(
        F.col("name").cast("long").alias("page_id"),
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
         min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM d"""
