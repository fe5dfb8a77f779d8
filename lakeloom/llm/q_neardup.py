"""op3: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .neardup import near_duplicates


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group. Rows that repeat id and text count once; an id with several texts has each compared on its own.

    Such texts go by a hash of id and text from 2^62 up, so that of a group a document with an id of its own stays.
    """
    counts = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if counts.limit(1).count():
        own = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).join(counts, "doc_id", "left")
        hashed = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        own = own.withColumn("_key", F.when(F.col("count").isNotNull(), hashed).otherwise(F.col("doc_id").cast("long")))
        keyed = own.select("_key", *docs.columns).unionByName(docs.filter("doc_id is null").withColumn("_key", F.lit(None).cast("long")))
    else:
        keyed = docs.withColumn("_key", F.col("doc_id"))
    gone = near_duplicates(keyed.select("_key", "text"), key="_key").filter("not kept").select(F.col("_key").alias("_gone")).distinct()
    return keyed.join(gone, keyed["_key"] == F.col("_gone"), "left_anti").select(*docs.columns)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
                                      WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                                      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), b AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2), e AS (
  SELECT a, b FROM b JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)), g AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (
  SELECT doc_id, doc_id AS near FROM documents
  UNION
  SELECT r.doc_id, g.b FROM r JOIN g ON g.a = r.near), c AS (
  SELECT doc_id, min(near) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id"""
