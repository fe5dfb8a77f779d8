from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from lakeloom.llm import common
from lakeloom.shared import shared_folder


def test_least_hashed_is_the_plain_top_k(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    want = [r["k"] for r in df.orderBy(F.pmod(F.xxhash64("k"), F.lit(1 << 31)), "k").limit(40).collect()]
    assert [r["k"] for r in common.least_hashed(df, "k", 40, 5000).collect()] == want
    assert common.least_hashed(df.limit(7), "k", 40, 7).count() == 7


def test_id_remainder_is_crc32_of_the_text(spark):
    df = spark.createDataFrame([(0,), (-5,), (123456789012,), (None,)], "doc_id long")
    got = [r[0] for r in df.select(common.id_remainder("doc_id", 7)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 7 for i in (0, -5, 123456789012)] + [None]


def test_let_evaluates_once(spark):
    df = spark.range(50).select(common.let(F.rand(), lambda x: F.struct((x - x).alias("zero"), (x >= 0).alias("fine"))).alias("v"))
    assert df.filter("v.zero = 0 and v.fine").count() == 50


def test_stored_and_discarded(spark):
    held = common.stored(spark.range(3), "held")
    assert held.count() == 3 and shared_folder(spark) in held._stored_path
    common.discard(held)
    assert spark.sparkContext._jvm.org.apache.hadoop.fs.Path(held._stored_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(held._stored_path)) is False


def test_tidy_passes_batches_on():
    batch = pa.RecordBatch.from_pydict({"a": [1]})
    assert list(common.tidy(lambda b: (x for x in b))(iter([batch, batch]))) == [batch, batch]


def test_spread_join_is_the_plain_join_and_deals_hot_keys_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 16)
    many = spark.range(1000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, if(id % 2 = 0, 0, id))) AS k", "id AS v")
    few = spark.range(0, 1000, 2).selectExpr("id AS k", "id * 10 AS w").union(spark.createDataFrame([(7, 70)], "k long, w long"))
    sizes = many.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        found = common.spread_join(many, few, ["k"], sizes, 1000, how)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, many.join(few, ["k"], how).collect()))
        assert "CartesianProduct" not in found._jdf.queryExecution().toString()
