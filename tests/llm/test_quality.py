from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import quality
from lakeloom.llm.q_quality import op4_quality_rules, stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    w = WORD.findall(text)
    at: dict[tuple, list[int]] = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark, sf_dir):
    odd = [None, "", " \n\t", "a", "a b c a b c", "a a a a a", "x y z\nx y z\n\n x y z", "\x0b\x0c\r é🙂 # <|> \x1c", "w " * 20_000, " a b", "a b a b a b a"]
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + odd
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.text_statistics(df).collect():
        assert tuple(r[c] for c in quality.COUNTS) == counts(texts[r["doc_id"]]), texts[r["doc_id"]]
        n, _, _, _, rep = counts(texts[r["doc_id"]])
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)


def test_query_keeps_good_and_drops_bad(spark, sf_dir):
    out = op4_quality_rules(spark, sf_dir.replace("0.001", "0.01"))
    assert out.columns[:8] == ["doc_id", *quality.COUNTS, "base_failed", "kept"]
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    r = out.join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {x["quality"]: x["kept"] for x in r}
    assert share[1] > 0.99 and share[0] < 0.15
    assert out.filter("base_failed and kept").count() == 0


def planted(spark):
    """Bad where x is large and y is small; a bit of noise."""
    rows = [(i, float(i % 10), float(i // 10 % 10), (i % 10 > 6 and i // 10 % 10 < 4) != (i % 97 == 0)) for i in range(3000)]
    return spark.createDataFrame(rows, "k long, x double, y double, _bad boolean").withColumn("_grow", F.col("k") % 3 > 0)


def test_covering_finds_a_conjunction(spark):
    rules = quality.learn_list(planted(spark), ("x", "y"))
    assert rules.rules and {c.feature for c in rules.rules[0].conditions} == {"x", "y"}
    hit = planted(spark).withColumn("r", rules.reason()).groupBy("_bad").agg(F.avg(F.col("r").isNotNull().cast("int")).alias("share")).collect()
    share = {r["_bad"]: r["share"] for r in hit}
    assert share[True] > 0.85 and share[False] < 0.03


def test_nothing_to_learn(spark):
    empty = planted(spark).limit(0)
    assert quality.learn_list(empty, ("x", "y")).rules == ()
    assert quality.learn_list(planted(spark).withColumn("_bad", F.lit(False)), ("x", "y")).rules == ()
    assert quality.learn_list(planted(spark).withColumn("_bad", F.lit(True)), ("x", "y")).rules == ()
    constant = planted(spark).withColumn("x", F.lit(1.0)).withColumn("y", F.lit(1.0))
    assert quality.learn_list(constant, ("x", "y")).rules == ()


@pytest.mark.parametrize("empty", ["documents", "labels", "neither"])
def test_stage_with_odd_rows_and_clashing_columns(spark, tmp_path, empty):
    good, bad = "word " + " ".join(f"w{i}" for i in range(60)), "## " * 70
    rows = [(1, good, 5), (1, good, 5), (None, good, 6), (2, None, 7), (3, "", 8), (4, bad, None)]
    docs = spark.createDataFrame([] if empty == "documents" else rows, "doc_id long, text string, n_words long").withColumn("kept", F.lit("x")).withColumn("_text", F.lit(0))
    spark.createDataFrame([] if empty == "labels" else [(1, 1, 0), (4, 0, 0), (9, 0, 0), (None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=repr) == ([] if empty == "documents" else sorted([(1, good, 5, "x", 0)] * 2 + [(None, good, 6, "x", 0)], key=repr))
