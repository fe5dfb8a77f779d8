from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import neardup, superminhash
from lakeloom.llm.components import components
from lakeloom.llm.neardup import near_duplicates
from lakeloom.llm.q_neardup import OP3_SQL, op3_minhash_near_dedup, stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text: str | None) -> frozenset:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows: list[tuple]) -> list[tuple]:
    sets = [shingle_set(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations([(r[0], s) for r, s in zip(rows, sets, strict=True) if r[0] is not None], 2):
        both = len(x & y)
        if both and 100 * both >= 75 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def check(spark, rows):
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)


def test_query_agrees_with_sql(same):
    same(op3_minhash_near_dedup, OP3_SQL)


def altered(words: list[str], n: int, rng: random.Random) -> str:
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"n{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("block", "levels"), [((512, 4096), 3), ((5, 7), 0), ((5, 7), 1)])
def test_group_whose_members_differ_more_from_each_other(spark, monkeypatch, block, levels):
    """Copies at 0.6 to 0.95 of one text, many of them not linked to each other, beside other groups."""
    monkeypatch.setattr(neardup, "LEVELS", levels)
    monkeypatch.setattr(neardup, "LEFT_BLOCK", block[0])
    monkeypatch.setattr(neardup, "RIGHT_BLOCK", block[1])
    rng = random.Random(4)
    base, other = ([f"{p}{i}" for i in range(150)] for p in "ab")
    texts = [altered(base, rng.randrange(8), rng) for _ in range(120)] + [altered(other, rng.randrange(4), rng) for _ in range(20)] + [" ".join(base)] * 15
    texts += [" ".join(base[:75] + other[75:]), " ".join(f"u{i}" for i in range(90))] + [" ".join(base[:40] + [f"q{j}x{i}" for i in range(12)]) for j in range(20)]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts, 100)))


def test_two_families_in_a_bucket_need_no_block(spark, monkeypatch):
    """300 variants of either of two texts that share most of their words: each row is compared with two leaders, not with all others."""
    rng, dealt = random.Random(5), []
    base = [f"w{i}" for i in range(200)]
    other = base[:140] + [f"v{i}" for i in range(60)]
    texts = [altered(b, 1, rng) for b in (base, other) for _ in range(300)]
    across = neardup._Run.across
    monkeypatch.setattr(neardup._Run, "across", lambda self, cells, reps: dealt.append(cells.count()) or across(self, cells, reps))
    out = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {(r["doc_id"] // 300, r["component_id"]) for r in out.collect()} == {(0, 0), (1, 300)} and not dealt


def test_links_near_the_threshold_are_found(spark):
    """Recall over pairs at a similarity of 0.75 to 0.8."""
    rng, rows, pairs = random.Random(6), [], 0
    for i in range(400):
        words = [f"p{i}x{j}" for j in range(124)]
        cut = rng.randrange(12, 16)
        both, either = 120 - cut, 120 + cut
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 124 - cut] + [f"q{i}x{j}" for j in range(cut)]))]
        pairs += 100 * both >= 75 * either
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert pairs == 400 and out.filter("not kept").count() == pairs


def test_a_low_threshold_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for part in (59, 101):
        with pytest.raises(ValueError, match="between"):
            near_duplicates(docs, part=part)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a b c d e"), (8, "A B\tc d\ne"), (None, "a b c d e"), (None, None), (9, "w " * 30_000), (10, "w " * 50), (4, "a"), (4, "a b c d e"), (-3, "z y x w v u"), (11, "z y x w v u")]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", 7, "s"), (2, "a b c d e f", 8, "t"), (2, "a b c d e f", 9, "t"), (3, "x", 1, "u"), (3, "x", 1, "u"), (None, "x", 2, "v")], "doc_id long, text string, id long, sig string")
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, "x"), (1, "a b c d e f"), (3, "x")]


def one_by_one(elements: np.ndarray, m: int) -> np.ndarray:
    out = np.full(m, superminhash.EMPTY, dtype=np.uint64)
    for e in elements:
        p = list(range(m))
        for j in range(m):
            k, v = (x[0] for x in superminhash._draw(np.array([e]), j, m))
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], v)
    return out


def test_signatures_equal_the_plain_algorithm():
    rng = np.random.default_rng(2)
    sizes = [1, 2, 0, 40, 300]
    elements = rng.integers(0, 2**63, sum(sizes)).astype(np.uint64)
    offsets = np.r_[0, np.cumsum(sizes)]
    found = superminhash.signatures(elements, offsets, 32)
    for i in range(len(sizes)):
        assert (found[i] == one_by_one(elements[offsets[i] : offsets[i + 1]], 32)).all()


def test_estimates_are_unbiased():
    rng, errors = np.random.default_rng(3), []
    for _ in range(200):
        k = int(rng.integers(0, 200))
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        b = np.r_[a[k:], rng.integers(0, 2**63, k).astype(np.uint64)]
        s = superminhash.signatures(np.r_[a, b], np.array([0, 300, 600]), 128)
        errors.append((s[0] == s[1]).mean() - (300 - k) / (300 + k))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045


def test_shingles_of_short_and_null_texts():
    _, offsets = superminhash.shingles(pa.array([None, "", "a", "a b c d", "a b c d e", "a b c d e a b c d e"]))
    assert np.diff(offsets).tolist() == [0, 0, 1, 1, 1, 5]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=25))
def test_components_of_random_graphs(spark, edges):
    root = list(range(15))
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    used = {x for a, b in edges if a != b for x in (a, b)}
    found = components(spark.createDataFrame([*edges, (None, 1)], "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted((x, root[x]) for x in used)


def test_components_of_a_long_path(spark):
    n = 400
    order = random.Random(1).sample(range(n), n)
    found = components(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long"))
    assert found.filter("component = 0").count() == n


def test_stage_keeps_every_text_of_a_repeated_id(spark):
    from lakeloom.llm.q_neardup import stage

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (2, c), (2, c), (3, c), (4, b), (5, a), (5, "one more text of its own here"), (None, "no id")]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(0, "no id"), (1, a), (3, c), (4, b), (5, "one more text of its own here")])
