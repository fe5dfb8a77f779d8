from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm.packing import BestFit, pack
from lakeloom.llm.q_packing import op1_best_fit_packing
from lakeloom.llm.tokens import tokenizer_path


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 5))
def test_places_are_best_fits_and_gapless(lengths, n_open):
    packer, open_bins, closed = BestFit(20, n_open), {}, set()
    for length in lengths:
        fits = sorted(20 - used for used in open_bins.values() if 20 - used >= length)
        number, offset = packer.place(length)
        if fits:
            assert 20 - open_bins[number] == fits[0]
        else:
            assert number not in open_bins and number not in closed
            if len(open_bins) == n_open:  # the fullest went
                least = min(20 - u for u in open_bins.values())
                gone = [b for b in open_bins if 20 - open_bins[b] == least and b not in _numbers(packer)]
                closed.add(gone[0])
                del open_bins[gone[0]]
            open_bins[number] = 0
        assert offset == open_bins[number]
        open_bins[number] += length
        assert open_bins[number] <= 20
        if open_bins[number] == 20:
            closed.add(number)
            del open_bins[number]


def _numbers(packer: BestFit) -> set[int]:
    return {b for bins in packer._free for b in bins}


def expected(rows):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), {}
    for key, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for at in range(0, len(ids), 2048):
            out.setdefault((key, at // 2048), []).append((at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())))
    return out


def verify(out, rows):
    got: dict = {}
    for r in out:
        got.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert got == expected(rows)
    filled: dict[int, int] = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert not filled or max(filled.values()) <= 2048
    return len(filled), sum(filled.values())


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    used, tokens = verify(op1_best_fit_packing(spark, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert used <= 1.02 * tokens / 2048 + docs.rdd.getNumPartitions()


@pytest.mark.parametrize("window", [1, 5000, 10**7])
def test_odd_rows(spark, window):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (None, "a"), (3, "word " * 2047), (4, "word " * 2048), (5, "word " * 6000), (6, "Same"), (6, "Same"), (7, "éà 🙂 \n\n x")]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).coalesce(2), window_tokens=window, open_bins=2)
    verify(out.withColumn("ids_crc32", F.crc32("ids")).collect(), rows)
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
