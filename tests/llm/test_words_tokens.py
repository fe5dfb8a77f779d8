"""Word hashes and part encodings against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import tokens, words
from lakeloom.llm.tokens import PartEncoder, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ \t\n\x0b\x0c\r\x1c\xa0é.,🙂", max_size=30)), max_size=12)


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_told_apart_and_in_order(texts):
    found = words.hash_words(pa.array(texts, pa.string()))
    names: dict[int, str] = {}
    assert len(found.offsets) == len(texts) + 1
    for i, t in enumerate(texts):
        own = WORD.findall(lower(t or ""))
        hashes = found.hashes[found.offsets[i] : found.offsets[i + 1]].tolist()
        assert len(own) == len(hashes)
        assert all(names.setdefault(h, w) == w for h, w in zip(hashes, own, strict=True))
    assert len(set(names.values())) == len(names)


def test_slices_cover_all_rows_and_long_texts():
    texts = pa.array(["a" * 10, "b" * 500, "", None, "c" * 3], pa.string())
    cuts = list(words.slices(texts, 20))
    assert cuts[0][0] == 0 and cuts[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
    long = "x" * 300_000 + " y"
    assert words.hash_words(pa.array([long])).counts.tolist() == [2]
    assert words.hash_words(pa.array([long])).hashes[1] == words.hash_words(pa.array(["y"])).hashes[0]


ODD = ["", " ", "a.b,c it's 'S don't!!", "É é H̱ T̈ ẖ", "<|endoftext|> x <|ENDOFTEXT|>", "İstanbul ﬁ Ǆ ß", "x\x0by\x1cz　q", "it'. 12ab.. 3.4", "\n\n a  \n", "日本語 текст 🙂." * 3]


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet="aAéH̱́ '.s1İ\n<|>", max_size=14), max_size=6))
def test_parts_encode_like_whole_texts(name, drops, texts):
    coder = tokens.encoder(tokenizer_path(name), drops)
    texts = texts + ODD
    want = [c.ids for c in coder._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode([t.encode() for t in texts])] == want


def test_store_of_parts_stays_small():
    coder = PartEncoder(tokenizer_path("word_bpe_49k.json"), True, most_parts=10)
    for i in range(20):
        coder.encode([" ".join(f"w{i}x{j}" for j in range(15)).encode()])
    assert len(coder._held) < 80
