from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import pieces
from lakeloom.llm.q_pieces import op2_sentencepiece
from lakeloom.llm.tokens import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def v():
    return pieces.vocabulary(PATH, 1.0)


def segmentations(v, text: str) -> dict[tuple[int, ...], float]:
    """All segmentations of a short text with their probabilities."""
    body = (" " + text).encode()
    known = {t: i for i, t in enumerate(v.text) if t and v.byte_ids[t[0]] != i}
    out: dict[tuple[int, ...], float] = {}

    def walk(at: int, ids: tuple[int, ...], weight: float) -> None:
        if at == len(body):
            out[ids] = weight
            return
        rest = body[at:]
        for n in range(1, len(rest) + 1):
            i = known.get(rest[:n])
            if i is not None and b"\n" not in rest[:n] and b" " not in rest[:n].lstrip(b" "):
                walk(at + n, (*ids, i), weight + v.weight[i])
        first = rest.decode()[0].encode()
        if first not in known:
            own = tuple(int(v.byte_ids[b]) for b in first)
            walk(at + len(first), ids + own, weight + sum(v.weight[i] for i in own))

    walk(0, (), 0.0)
    top = max(out.values())
    total = sum(np.exp(w - top) for w in out.values())
    return {k: float(np.exp(w - top) / total) for k, w in out.items()}


@pytest.mark.parametrize(("text", "alpha"), [("hello", 0.3), ("a\nb é☃", 0.2), ("  ▁to", 0.1)])
def test_draws_follow_the_exact_distribution(text, alpha):
    v, n = pieces.vocabulary(PATH, alpha), 20_000
    want = segmentations(v, text)
    ids, offsets = pieces.sample_batch(v, np.arange(n), pa.array([text] * n), 9)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False))
    assert set(got) <= set(want) and len(want) > 3
    for k, p in want.items():
        assert abs(got[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 2e-3


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet=" a\n▁", max_size=20)), min_size=1, max_size=6))
def test_decoding_is_lossless(v, texts):
    ids, offsets = pieces.sample_batch(v, np.arange(len(texts)), pa.array(texts, pa.string()), 1)
    assert pieces.decode_batch(v, ids, offsets).to_pylist() == [t or "" for t in texts]


def test_draws_do_not_depend_on_the_batch(v):
    texts = ["some words here", "other words", "some words here"] * 5
    keys = np.arange(15)
    ids, offsets = pieces.sample_batch(v, keys, pa.array(texts), 4)
    for i in range(15):
        own, _ = pieces.sample_batch(v, keys[i : i + 1], pa.array(texts[i : i + 1]), 4)
        assert own.tolist() == ids[offsets[i] : offsets[i + 1]].tolist()


def test_long_text(v):
    for t in ("x" * 20_000, " " * 5_000, "ab " * 50_000):
        ids, offsets = pieces.sample_batch(v, np.array([1]), pa.array([t]), 1)
        assert pieces.decode_batch(v, ids, offsets).to_pylist() == [t]


def test_operators_with_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (None, "a b"), (3, "x y"), (3, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    coded = pieces.encode(df, PATH)
    assert coded.columns == ["doc_id", "text", "ids"]
    out = pieces.decode(coded.withColumn("decoded", F.lit(1)), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in out) == [(0, "a b"), (1, ""), (2, ""), (3, "x y"), (3, "x y")]
    same = [tuple(r["ids"]) for r in out if r["doc_id"] == 3]
    assert same[0] == same[1]
    missing = spark.createDataFrame([([1, 2],), (None,)], "ids array<int>")
    assert pieces.decode(missing, PATH).filter("ids is null and decoded is null").count() == 1
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query_is_lossless(spark, sf_dir):
    out = op2_sentencepiece(spark, sf_dir).collect()
    assert len(out) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and all(r["lossless"] for r in out)
