"""Word shingles and SuperMinHash signatures, vectorised over the texts of a batch.

SuperMinHash draws, for every element, a random permutation of the m signature
places and writes rank + fraction there; each place keeps its least value. The
ranks of one element are correlated (no place twice), which lowers the variance
of the estimate. Round j hands out rank j of all elements at once; a text leaves
as soon as all its places hold a value below j, because later rounds could only
write larger ones. The result is the same as element by element.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import GOLDEN, U, hash_words, mix, slices, stream

EMPTY = U(0xFFFFFFFFFFFFFFFF)
_TRACED = 8


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct `width`-word shingles of each text, sorted, and their offsets.

    A text of fewer words has its whole sequence as its one shingle; without words it has none.
    """
    parts = [_shingles(texts.slice(a, b - a), width) for a, b in slices(texts)]  # hashing takes some 40 bytes a byte
    sizes = np.concatenate([np.diff(o) for _, o in parts]) if parts else np.zeros(0, dtype=np.int64)
    return np.concatenate([e for e, _ in parts]) if parts else np.zeros(0, dtype=np.uint64), np.r_[0, np.cumsum(sizes)]


def _shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    words = hash_words(texts)
    n = words.counts
    factors = stream(97, width)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(words.hashes) - width + 1), dtype=np.uint64)
        for k in range(width):
            full += words.hashes[k : k + len(full)] * factors[k]
        full = mix(full)
        sets = []
        for i, size in enumerate(n):
            at = words.offsets[i]
            if size >= width:
                sets.append(np.unique(full[at : at + size - width + 1]))
            elif size:
                short = (words.hashes[at : at + size] * factors[:size]).sum(dtype=np.uint64)
                sets.append(mix(np.array([short + U(size) * GOLDEN])))
            else:
                sets.append(np.zeros(0, dtype=np.uint64))
    offsets = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64), offsets


def set_keys(elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums per set; equal sets have equal keys."""
    full = np.flatnonzero(np.diff(offsets))
    keys = (np.zeros(len(offsets) - 1, dtype=np.uint64), np.zeros(len(offsets) - 1, dtype=np.uint64))
    if len(full):
        with np.errstate(over="ignore"):
            for key, salt in zip(keys, (U(0x51ED270B7A1F), U(0x2545F4914F6CDD1D)), strict=True):
                key[full] = np.add.reduceat(mix(elements ^ salt), offsets[:-1][full])
    return keys


def _draw(elements: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of round j: the place to swap with, in j..m-1, and rank j with a 56-bit fraction."""
    with np.errstate(over="ignore"):
        x = mix(elements + U(j + 1) * GOLDEN)
        y = mix(x ^ U(0x6A09E667F3BCC909))
    return (U(j) + (((y >> U(32)) * U(m - j)) >> U(32))).astype(np.int16), (U(j) << U(56)) | (x >> U(8))


def signatures(elements: np.ndarray, offsets: np.ndarray, m: int = 128) -> np.ndarray:
    """An array (sets, m) of 64-bit values; an empty set has EMPTY everywhere. m is 255 at most."""
    n_sets = len(offsets) - 1
    out = np.full((n_sets, m), EMPTY, dtype=np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n_sets), np.diff(offsets))
    swaps: list[np.ndarray] = []
    order: np.ndarray | None = None
    for j in range(m):
        if j:
            going = out.max(axis=1) >= U(j) << U(56)
            keep = going[owner]
            if not keep.all():
                elements, owner = elements[keep], owner[keep]
                swaps = [s[keep] for s in swaps]
                order = order[keep] if order is not None else None
        if not len(elements):
            break
        k, value = _draw(elements, j, m)
        if order is None and j < _TRACED:
            place = k.copy()
            for i in range(j - 1, -1, -1):  # where the swaps before would have brought it from
                s = swaps[i]
                place = np.where(place == s, i, np.where(place == i, s, place)).astype(np.int16)
            swaps.append(k)
        else:
            rows = np.arange(len(elements))
            if order is None:
                order = np.tile(np.arange(m, dtype=np.uint8), (len(elements), 1))
                for i, s in enumerate(swaps):
                    held = order[:, i].copy()
                    order[:, i] = order[rows, s]
                    order[rows, s] = held
                swaps = []
            place = order[rows, k].astype(np.int16)
            order[rows, k] = order[:, j]
            order[:, j] = place
        np.minimum.at(flat, owner * m + place, value)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of rows, different between bands."""
    n, m = signature.shape
    rows = m // bands
    factors = stream(3, rows)
    with np.errstate(over="ignore"):
        summed = (mix(signature[:, : bands * rows].reshape(n, bands, rows)) * factors).sum(axis=2, dtype=np.uint64)
        return mix(summed + np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)


def compact(signature: np.ndarray) -> np.ndarray:
    """One byte for each place, for estimates."""
    return (mix(signature) >> U(56)).astype(np.uint8)
