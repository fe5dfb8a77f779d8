from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.llm import toxicity
from lakeloom.llm.common import id_remainder
from lakeloom.llm.q_toxicity import op6_toxicity, stage
from lakeloom.llm.toxicity import Calibration, segments


def brute(scores: list[float]) -> list[tuple[int, int, float]]:
    """Maximal scoring segments by their definition: the best one, then the same left and right of it."""

    def solve(lo: int, hi: int) -> list[tuple[int, int, float]]:
        best = (0.0, 0, 0)
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += scores[b]
                if total > best[0] + 1e-9 or abs(total - best[0]) <= 1e-9 and total > 0 and b + 1 - a < best[2] - best[1]:
                    best = (total, a, b + 1)
        if best[0] <= 0:
            return []
        return [*solve(lo, best[1]), (best[1], best[2], best[0]), *solve(best[2], hi)]

    return solve(0, len(scores))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([None, None, None, 1.3, 2.7, 0.41]), max_size=25))
def test_segments_are_the_maximal_ones(marks):
    scores = [-0.5 if m is None else m for m in marks]
    at = [i for i, m in enumerate(marks) if m is not None]
    found = segments(at, [marks[i] for i in at], 0.5)
    assert [(s, e, round(x, 6)) for s, e, x in found] == [(s, e, round(x, 6)) for s, e, x in brute(scores)]


def test_chance_is_a_probability_that_falls_with_the_score():
    c = Calibration(1.0, 0.5)
    chances = [c.chance(s, 500) for s in (0, 1, 5, 10, 20, 1000)]
    assert chances == sorted(chances, reverse=True) and all(0 <= x <= 1 for x in chances) and c.chance(3, 0) >= 0


def test_query_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    out = op6_toxicity(spark, big)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    scored = out.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out")
    r = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"), F.count_if(F.expr("predicted = 1 and toxic = 0")).alias("wrong"), F.count("*").alias("n")).first()
    assert r["right"] > 0.97 and r["wrong"] < 0.01 * r["n"]
    assert out.filter("score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0


def planted(spark, n=400):
    rng = random.Random(1)
    clean, toxic = [f"c{i}" for i in range(300)], ["grr", "bah", "ugh"]
    rows = []
    for i in range(n):
        words = rng.choices(clean, k=80)
        if i % 8 == 0:
            at = rng.randrange(60)
            words[at : at + 6] = rng.choices(toxic, k=6)
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_passages_are_found_where_they_are(spark):
    docs = planted(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), teaches=id_remainder("doc_id", 5) != 0)
    text = "calm words here " * 40 + "GRR! bah, ugh grr bah" + " and more calm words" * 40
    (r,) = model.apply(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["predicted"] == 1 and [(p["start_word"], p["end_word"]) for p in r["passages"]] == [(120, 125)]


def test_held_out_labels_do_not_matter(spark):
    docs = planted(spark)
    teaches = id_remainder("doc_id", 5) != 0
    flipped = docs.select("doc_id", F.when(id_remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    scores = [sorted(map(tuple, toxicity.fit(docs, labels, teaches=teaches).apply(docs).select("doc_id", "score").collect())) for labels in (docs.select("doc_id", "toxic"), flipped)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("labels", ["none", "one class", "odd"])
def test_odd_rows(spark, labels):
    docs = planted(spark)
    known = {"none": docs.select("doc_id", "toxic").limit(0), "one class": docs.select("doc_id", F.lit(0).alias("toxic")), "odd": docs.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("toxic")).alias("toxic")).union(spark.createDataFrame([(None, 1), (10**9, 1)], "a long, b int"))}[labels]
    model = toxicity.fit(docs, known)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "grr bah ugh " * 5), (3, "c1 " * 30_000), (3, "c1"), (4, "grr bah ugh " * 5)], "doc_id long, text string").withColumn("score", F.lit("x"))
    out = {(r["doc_id"], r["n_words"]): r["predicted"] for r in model.apply(odd).collect()}
    assert len(out) == 6 and out[(1, 0)] == 0 and out[(3, 30_000)] == 0
    assert (out[(4, 15)] == 1) == (labels == "odd") == (out[(None, 15)] == 1)
    assert model.keep(odd).columns == odd.columns and model.keep(odd).count() == (4 if labels == "odd" else 6)
    assert model.apply(docs.limit(0)).count() == 0


def test_stage_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert stage(spark, docs, str(tmp_path)).columns == docs.columns and stage(spark, docs, str(tmp_path)).count() == 0
