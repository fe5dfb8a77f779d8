from __future__ import annotations

import itertools
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import hmm
from lakeloom.llm.common import id_remainder
from lakeloom.llm.q_lm import op8_lm_scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def base(rows, teaches):
    counts = Counter(t for i, x in rows if teaches(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return n, [(len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x))) for _, x in rows]


def chain(k=3, seed=0, rows=40):
    rng = np.random.default_rng(seed)
    return hmm.Chain(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(rows), k).T)


def by_paths(c, seq):
    total = 0.0
    for path in itertools.product(range(len(c.start)), repeat=len(seq)):
        p = c.start[path[0]] * c.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= c.move[path[t - 1], path[t]] * c.emit[seq[t], path[t]]
        total += p
    return np.log10(total)


def plain(c, seq):
    """Expected counts (start, move, emit) and log10 P of one sequence, by the textbook recursions."""
    n, k = len(seq), len(c.start)
    alpha, beta, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        alpha[t] = (c.start if t == 0 else alpha[t - 1] @ c.move) * c.emit[seq[t]]
        scale[t] = alpha[t].sum()
        alpha[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = c.move @ (c.emit[seq[t + 1]] * beta[t + 1]) / scale[t + 1]
    move, emit = np.zeros((k, k)), np.zeros_like(c.emit)
    for t in range(n):
        emit[seq[t]] += alpha[t] * beta[t]
        if t:
            move += c.move * np.outer(alpha[t - 1], c.emit[seq[t]] * beta[t]) / scale[t]
    return alpha[0] * beta[0], move, emit, np.log10(scale).sum()


def test_forward_recursion_is_exact():
    c, rng = chain(), np.random.default_rng(1)
    seqs = [rng.integers(0, 40, n) for n in (1, 5, 3, 6, 1)]
    offsets = np.r_[0, np.cumsum([len(s) for s in seqs])]
    assert np.allclose(c.likelihood(np.concatenate(seqs), offsets), [by_paths(c, s) for s in seqs])
    assert np.allclose([plain(c, s)[3] for s in seqs], [by_paths(c, s) for s in seqs])


@pytest.mark.parametrize(("stretch", "batch"), [(1, 1), (2, 50), (7, 1), (64, 300), (256, 1 << 18), (5000, 1 << 18)])
def test_expected_counts_are_exact_at_any_block_size(monkeypatch, stretch, batch):
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    monkeypatch.setattr(hmm, "BATCH", batch)
    c, rng = chain(4, 3), np.random.default_rng(2)
    seqs = [rng.integers(0, 40, n) for n in (3, 1000, 1, 64, 65, 257, 14)]
    offsets = np.r_[0, np.cumsum([len(s) for s in seqs])]
    sums = hmm.Sums.zero(4, 40)
    c.expect(np.concatenate(seqs), offsets, sums)
    start, move, emit, logs = (sum(x) for x in zip(*(plain(c, s) for s in seqs), strict=True))
    assert np.allclose(sums.start, start) and np.allclose(sums.move, move) and np.allclose(sums.emit, emit) and np.isclose(sums.likelihood[0], logs)
    assert np.allclose(c.likelihood(np.concatenate(seqs), offsets), [plain(c, s)[3] for s in seqs])


def test_an_expectation_writes_two_arrays_of_all_tokens():
    """Emissions and forward variables; the backward variables of one time are all it needs, and posteriors go where emissions were."""
    c, seq = chain(8, 5), np.random.default_rng(6).integers(0, 40, 100_000)
    offsets, sums = np.arange(0, len(seq) + 1, 500), hmm.Sums.zero(8, 40)
    tracemalloc.start()
    try:
        c.expect(seq, offsets, sums)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * len(seq) * 8 * 8


def test_arrays_left_by_one_chunk_change_nothing_in_the_next():
    rng, room = np.random.default_rng(3), hmm.Room()
    for k, sizes in ((4, (700, 3, 5000)), (2, (9, 1)), (4, (6000, 2)), (3, (4100,))):
        c, seq, offsets = chain(k, k), rng.integers(0, 40, sum(sizes)), np.r_[0, np.cumsum(sizes)]
        used, fresh = hmm.Sums.zero(k, 40), hmm.Sums.zero(k, 40)
        c.expect(seq, offsets, used, room)
        c.expect(seq, offsets, fresh)
        assert all(np.array_equal(getattr(used, x), getattr(fresh, x)) for x in ("start", "move", "emit", "likelihood"))
        assert np.array_equal(c.likelihood(seq, offsets, room), c.likelihood(seq, offsets))


def test_chunks_come_back_as_they_were():
    chunk = hmm.Chunk.of(pa.array(["a b a", None, "", "c B"]), pa.array([1, None, 3, 4], pa.int64()), np.array([True, False, True, True]))
    ((block, back),) = hmm.Chunk.read(chunk.row(7))
    assert block == 7 and back.keys.to_pylist() == [1, None, 3, 4] and np.diff(back.offsets).tolist() == [4, 1, 1, 3]
    assert (back.words[back.codes] == chunk.words[chunk.codes]).all() and back.teaching().keys.to_pylist() == [1, 3, 4]
    assert (hmm.classes_of(back.words[back.codes])[back.offsets[1:] - 1] == hmm.END).all()


def two_kinds(n=60):
    return [" ".join(f"{'ab'[i % 2]}{(i * 7 + j * j) % 9}" for j in range(40)) for i in range(n)]


def test_passes_raise_the_likelihood_until_they_gain_little(spark):
    docs = spark.createDataFrame(list(enumerate(two_kinds())), "doc_id long, text string").repartition(3)
    few = hmm.train(hmm.chunked(docs, F.lit(True), "doc_id", "text"), 2, 0.01, 0.05)[1]
    chain, seen = hmm.train(hmm.chunked(docs, F.lit(True), "doc_id", "text"), 2, 0.01, 1e-5)
    gains = np.diff(seen)
    assert len(seen) >= len(few) and (gains > -1e-6).all() and (gains[:-1] >= 1e-5).all() and gains[-1] < 1e-5
    assert np.allclose(chain.emit.sum(axis=0), 1) and np.allclose(chain.move.sum(axis=1), 1)


def test_seeds_count_all_texts_in_any_partitioning(spark):
    docs = spark.createDataFrame(list(enumerate(two_kinds())), "doc_id long, text string")
    one, three = (hmm.seed_sums(hmm.chunked(docs.repartition(n), F.col("doc_id") % 5 > 0, "doc_id", "text"), 2, 0.01, 2, 4) for n in (1, 3))
    assert np.isclose(one[0].start.sum(), 48) and np.isclose(one[0].emit.sum(), 48 * 41) and one[1].sum() == 48 * 41
    assert np.allclose(one[0].start, three[0].start) and np.allclose(one[0].emit, three[0].emit)
    assert np.allclose(sorted(one[0].start), [24, 24], atol=1)  # a state for each kind of text


def test_mixtures_side_by_side_are_like_each_alone():
    chunk = hmm.Chunk.of(pa.array(["a b a", "b c", "", "c c b"]))
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(hmm.CLASSES), 4).T)
    both, prior = hmm.Sums.zero(4), np.log([0.3, 0.7, 0.6, 0.4])
    hmm.add_mixture(logs, prior, 2, chunk, both)
    for i in range(2):
        emit, start, total = np.zeros((hmm.CLASSES, 2)), np.zeros(2), 0.0
        for a, b in zip(chunk.offsets, chunk.offsets[1:], strict=False):
            text = hmm.classes_of(chunk.words)[chunk.codes[a:b]]
            each = np.array([np.exp(prior[2 * i + j] + logs[text, 2 * i + j].sum()) for j in range(2)])
            total, start = total + np.log10(each.sum()), start + each / each.sum()
            for j, p in enumerate(each / each.sum()):
                np.add.at(emit[:, j], text, p if p >= 1e-4 else 0)
        own = slice(2 * i, 2 * i + 2)
        assert np.allclose(both.emit[:, own], emit) and np.allclose(both.start[own], start) and np.isclose(both.likelihood[i], total)


@pytest.mark.parametrize("common", [1, 3, 512])
def test_common_and_other_classes_of_a_mixture_add_up(monkeypatch, common):
    """Classes in the table of texts and those counted by token give what counting every token gives."""
    monkeypatch.setattr(hmm, "COMMON", common)
    rng = np.random.default_rng(4)
    texts = ["", *(" ".join(f"w{x}" for x in rng.zipf(1.3, n) % 300) for n in (1, 4, 60, 900, 33, 7))]
    chunk = hmm.Chunk.of(pa.array(texts))
    logs, prior = np.log(rng.dirichlet(np.ones(hmm.CLASSES), 3).T), np.log([0.2, 0.5, 0.3])
    sums, emit, start, total = hmm.Sums.zero(3), np.zeros((hmm.CLASSES, 3)), np.zeros(3), 0.0
    hmm.add_mixture(logs, prior, 1, chunk, sums)
    for a, b in zip(chunk.offsets, chunk.offsets[1:], strict=False):
        text = hmm.classes_of(chunk.words)[chunk.codes[a:b]]
        fit = prior + logs[text].sum(axis=0)
        post = np.exp(fit - fit.max())
        total, start = total + (fit.max() + np.log(post.sum())) / np.log(10), start + post / post.sum()
        np.add.at(emit, text, np.where(post / post.sum() >= 1e-4, post / post.sum(), 0))
    assert np.allclose(sums.emit, emit) and np.allclose(sums.start, start) and np.isclose(sums.likelihood[0], total)


@pytest.mark.parametrize("head", [2, 1 << 18])
def test_base_and_odd_rows(spark, monkeypatch, head):
    """With a table of two common words, nearly all counts come through the join."""
    monkeypatch.setattr(hmm, "HEAD", head)
    rows = [(i, t) for i, t in enumerate([None, "", "The the THE cat", "a cat  sat\non a mat", "dog", "a b c d e f g", "x " * 5000, "the \x0b é"] * 3)]
    rows += [(3, "a cat  sat\non a mat"), (None, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = hmm.fit(docs, id_remainder("doc_id", 7) != 2, states=2)
    out = model.score()
    assert sorted(map(repr, out.collect())) == sorted(map(repr, model.score(docs).collect()))
    assert out.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    n, want = base(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2)
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out.collect())
    assert got == sorted((i or 0, a, b, round(c, 6)) for (i, _), (a, b, c) in zip(rows, want, strict=True))
    assert {r["train_tokens"] for r in out.collect()} == {n} and out.filter("score >= 0 or isnan(score)").count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = hmm.fit(docs, F.lit(False), states=2).score().collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in out] == [(0, 0, 0.0)] * 2 and all(r["score"] <= 0 for r in out)
    assert hmm.fit(docs.limit(0), F.lit(True), states=2).score().count() == 0


def test_query_beats_the_base_on_held_out_rows(spark, sf_dir):
    out = op8_lm_scoring(spark, sf_dir.replace("0.001", "0.01"))
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    r = out.groupBy("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).collect()
    assert len(r) == 2 and all(x["s"] > x["b"] for x in r)


def same_class():
    seen = {}
    for i in itertools.count():
        kind = int(hmm.classes_of(hmm.Chunk.of(pa.array([f"w{i}"])).words)[0])
        if kind in seen:
            return seen[kind], f"w{i}"
        if kind != hmm.END:
            seen[kind] = f"w{i}"


@pytest.mark.parametrize("head", [2, 1 << 18])
def test_words_of_a_class_have_states_of_their_own(spark, monkeypatch, head):
    """Two equally common words of one class in different company; scores against the formula, word by word."""
    monkeypatch.setattr(hmm, "HEAD", head)
    one, two = same_class()
    rows = [(i, f"a b c a b c {one} a b" if i % 2 else f"x y z x y z {two} x y") for i in range(60)]
    model = hmm.fit(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), states=2, weight=1.0)
    asked = [(1, f"a b c {one} a"), (2, f"a b c {two} a"), (3, f"x y z {one} x"), (4, f"x y z {two} x"), (5, "never seen a"), (6, "a " * 3000), (7, "")]
    got = {r["doc_id"]: r["score"] for r in model.score(spark.createDataFrame(asked, "doc_id long, text string")).collect()}
    assert got[1] > got[2] + 0.5 and got[4] > got[3] + 0.5

    held = model.states.toPandas()
    hashes, counts = held["h"].to_numpy().view(np.uint64), held["c"].to_numpy()
    sums, kinds = hmm.unpacked([held["w0"].to_numpy()], counts, 2), hmm.classes_of(hashes)
    assert dict(zip(hashes.tolist(), counts.tolist(), strict=True)) == Counter(int(h) for _, t in rows for h in hmm._tokens(pa.array([t]))[0])
    size = {c: 1 + sum(counts[kinds == c] + 1) for c in set(kinds.tolist()) - {hmm.END}}
    total, kept = sums.sum(axis=0) + 1.0, sums * (counts / (counts + 1))[:, None]
    back = (sums - kept).sum(axis=0) + 1.0

    def probability(h):
        kind, at = int(hmm.classes_of(np.array([h], dtype=np.uint64))[0]), np.flatnonzero(hashes == h)
        c, own = (counts[at[0]], kept[at[0]]) if len(at) else (0, np.zeros(2))
        share = 1.0 if kind == hmm.END else (c + 1) / size.get(kind, 1)
        return (own + back * model.chain.emit[kind] * share) / total

    for key, text in asked:
        seq = hmm._tokens(pa.array([text]))[0]
        c = hmm.Chain(model.chain.start, model.chain.move, np.array([probability(h) for h in seq]))
        assert np.isclose(plain(c, np.arange(len(seq)))[3], got[key])
    whole = sum(probability(h) for h in hashes)
    unseen = sum(back * model.chain.emit[c] / size.get(c, 1) for c in range(hmm.CLASSES - 1)) / total
    assert np.allclose(whole + unseen, 1, atol=1e-4)
