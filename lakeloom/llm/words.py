"""Vectorised splitting and hashing of words over Arrow string columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D. A word's hash depends on
its bytes alone: a sum of byte codes times position codes modulo 2^64, mixed at
the end, so that it is the same in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SHIFTS = (U(30), U(27), U(31))
_MULS = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
GOLDEN = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix64 generator."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _SHIFTS[0])) * _MULS[0]
        x = (x ^ (x >> _SHIFTS[1])) * _MULS[1]
    return x ^ (x >> _SHIFTS[2])


def stream(seed: int, n: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + U(seed)) * GOLDEN) | U(1)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_INK = ~_SPACE
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_PLAIN = stream(11, 256)
_LOWER = _PLAIN.copy()
_LOWER[ord("A") : ord("Z") + 1] = _PLAIN[ord("a") : ord("z") + 1]
_PLACE = stream(7_000_003, 4096)


def _places(n: int) -> np.ndarray:
    return _PLACE if n <= len(_PLACE) else stream(7_000_003, n)


class Words:
    """Word hashes of some texts: `hashes` in order, those of text i at offsets[i]:offsets[i + 1]."""

    __slots__ = ("hashes", "offsets")

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray):
        self.hashes, self.offsets = hashes, offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column and the offset of each text in them; null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - offsets[0]


def bounds(ink: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every run of marked bytes; a text's end also ends a run."""
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = offsets[(offsets > 0) & (offsets < len(ink))]
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_words(texts: pa.Array, lower: bool = True, letters: bool = False) -> Words:
    """letters: words are runs of ASCII letters, digits and bytes from 0x80 instead."""
    raw, offsets = text_buffer(texts)
    if not len(raw):
        return Words(np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64))
    ink = (_LETTERS if letters else _INK)[raw]
    starts, ends = bounds(ink, offsets)
    where = np.searchsorted(starts, offsets).astype(np.int64)
    if not len(starts):
        return Words(np.zeros(0, dtype=np.uint64), where)
    sizes = ends - starts
    code = (_LOWER if lower else _PLAIN)[raw[ink]]
    begins = np.zeros(len(sizes), dtype=np.int64)
    np.cumsum(sizes[:-1], out=begins[1:])
    place = np.arange(len(code), dtype=np.int64) - np.repeat(begins, sizes)
    with np.errstate(over="ignore"):
        code *= _places(int(sizes.max()))[place]
        total = np.add.reduceat(code, begins) + sizes.astype(np.uint64) * GOLDEN
    return Words(mix(total), where)


def slices(texts: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most_bytes` of text each; a longer text has a range of its own."""
    _, offsets = text_buffer(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        yield at, end
        at = end
