from __future__ import annotations

import corpus_pipeline
from lakeloom.llm.common import table


def test_stages_keep_columns_and_pass_on_fewer_rows(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    docs = table(spark, sf_dir, "documents")
    columns, left = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near-duplicates", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        now = docs.count()
        assert 0 < now < left, name
        left = now


def test_run_packs_what_the_stages_keep(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
