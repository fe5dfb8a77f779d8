from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import archives, tokenfiles
from lakeloom.llm.common import scratch
from lakeloom.llm.q_tokens import op5_token_counts
from lakeloom.llm.tokens import tokenizer_path


def lengths(ids: list[int]) -> list[tuple[int, bool]]:
    out, n = [], 0
    for i in ids:
        if i == 0:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=4), st.sampled_from([1, 2, 7, 1000]), st.sampled_from([2, 4]))
def test_scan_stitches_blocks(spark, files, block, width):
    folder = scratch(spark, "files")
    for i, ids in enumerate(files):
        archives.put(f"{folder}/f{i}.tok", np.array(ids, dtype=f"<u{width}").tobytes())
    archives.put(f"{folder}/_part.tok", b"\1\0\0\0")
    found: dict[str, list] = {}
    for r in tokenfiles.scan_token_files(spark, folder, 0, width, block).orderBy("file", "number").collect():
        assert r["number"] == len(found.setdefault(r["file"], []))
        found[r["file"]].append((r["n_tokens"], r["closed"]))
    assert found == {f"f{i}.tok": lengths(ids) for i, ids in enumerate(files) if ids}


def test_query_against_the_tokenizer(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted((r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs)
    assert sorted(map(tuple, op5_token_counts(spark, sf_dir).collect())) == want


@pytest.mark.parametrize("most", [1, 10**6])
def test_odd_rows_round_trip(spark, most):
    rows = [(1, None), (2, ""), (None, "one two"), (3, "a<|endoftext|>b <|endoftext|>"), (3, "a<|endoftext|>b <|endoftext|>"), (4, "w " * 20_000)]
    folder = scratch(spark, "tokens")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = tokenfiles.write_token_files(docs.coalesce(1), folder, "doc_id", "text", tokenizer_path("byte_bpe_50k.json"), 50256, most_tokens=most).collect()
    found = {(r["file"], r["number"]): r["n_tokens"] for r in tokenfiles.scan_token_files(spark, folder, 50256, block_tokens=100).collect()}
    assert len(found) == len(names) == len(rows)
    counts = sorted((r["id"] or 0, found[(r["file"], r["number"])]) for r in names)
    assert counts[1:3] == [(1, 0), (2, 0)] and counts[3] == counts[4] and counts[3][1] > 4 and counts[5][1] >= 20_000


def test_empty_tables(spark):
    folder = scratch(spark, "tokens")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfiles.write_token_files(docs, folder, "doc_id", "text", tokenizer_path("byte_bpe_50k.json"), 50256).count() == 0
    assert tokenfiles.scan_token_files(spark, folder, 50256).count() == 0
