"""Every public function in a session of its own, started where executors find no copy of this package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
from lakeloom.llm import hmm, media, neardup, packing, pieces, tokenfiles, toxicity, urlfilter, warc
from lakeloom.llm.tokens import tokenizer_path

pieces_path = tokenizer_path("piece_bpe_32k.model")
calls = {
    "pack": lambda d, f: packing.pack(d),
    "encode": lambda d, f: pieces.encode(d, pieces_path),
    "decode": lambda d, f: pieces.decode(d.select("doc_id", F.array().cast("array<int>").alias("ids")), pieces_path),
    "near_duplicates": lambda d, f: neardup.near_duplicates(d),
    "write_token_files": lambda d, f: tokenfiles.write_token_files(d, f, "doc_id", "text", tokenizer_path("byte_bpe_50k.json"), 50256),
    "toxicity": lambda d, f: toxicity.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))).apply(d),
    "apply": lambda d, f: toxicity.Model(toxicity.np.zeros(toxicity.BUCKETS, dtype="float32"), toxicity.Calibration(), toxicity.Options()).keep(d),
    "archive": lambda d, f: warc.read_warcs(d.sparkSession, warc.archive(d, "doc_id", "text", "text")),
    "hmm": lambda d, f: hmm.fit(d, F.lit(True), states=2, least_gain=9.0).score(),
    "urls": lambda d, f: urlfilter.judge_urls(d, (), url="text"),
    "media": lambda d, f: media.read_archives(d.sparkSession, media.store_payloads(d, "doc_id", "text")),
}
for name, call in calls.items():
    folder = f"file://{sys.argv[2]}/{name}"
    spark = SparkSession.builder.master("local[2]").config(map={"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": folder}).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    assert call(docs, folder + "-files").count() == 3, name
    spark.stop()
print("all", len(calls))
"""


def test_public_functions_bring_the_package_with_them(tmp_path):
    repo = Path(__file__).resolve().parents[2]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(repo), str(tmp_path)], cwd=tmp_path, capture_output=True, text=True, timeout=600, env=env)
    assert done.stdout.strip().endswith("all 11"), done.stdout[-500:] + done.stderr[-3000:]
