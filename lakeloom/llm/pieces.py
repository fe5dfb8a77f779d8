"""Sampled segmentations of texts into the pieces of a SentencePiece vocabulary, and decoding.

Forward-filtering backward-sampling over the piece lattice: forward sums give every place of
a text the weight of all ways to reach it; walking back from the end, each piece is drawn
with its share of that weight, so a whole segmentation is drawn with the exact probability
that is proportional to the product of its pieces' weights. Draws depend on the seed, the
row's key, the unit's place in the text and the step, so they do not depend on how rows are
dealt to tasks.

A piece's weight is (rank + 10) ** -alpha with its rank in the vocabulary. No piece goes on
over the start of a run of spaces or a line feed, so the lattice falls into independent
units there, and a unit that a batch holds many times is built once. A character without
a piece is written as its bytes. As SentencePiece does, a space is put before the text
(decoding takes it away); unlike it, nothing else is normalised, so decoding gives the very
text. Null and empty texts have no ids. A null key draws like key 0; rows that repeat
key and text repeat the ids. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy
from .words import GOLDEN, U, mix, slices, stream, text_buffer

_CODE = stream(23, 256)
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BACK = U(pow(int(_BASE), -1, 1 << 64))
_FILTER = (1 << 20) - 1


class Vocabulary:
    """The pieces of a model file as bytes, a hash table to find them, and byte pieces."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text: list[bytes] = [b""] * n
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        found: list[tuple[int, bytes]] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.text[i] = bytes([int(piece[1:-1], 16)])
                self.byte_ids[self.text[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                body = piece.replace("▁", " ").encode()
                self.text[i] = body
                if b"\n" not in body and b" " not in body.lstrip(b" "):
                    found.append((i, body))
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary needs a piece for each byte")
        self.weight = -alpha * np.log(np.arange(n) + 10.0)
        self.lengths = sorted({len(b) for _, b in found})
        hashes = np.array([self._hash(b) for _, b in found], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([i for i, _ in found], dtype=np.int32)[order]
        slot = (self.hashes & U(_FILTER)).astype(np.int64)
        self.slot = np.full(_FILTER + 1, -1, dtype=np.int32)  # a piece of each slot
        self.slot[slot] = np.arange(len(slot))
        self.crowded = np.bincount(slot, minlength=_FILTER + 1) > 1
        self.reach = np.zeros(_FILTER + 1, dtype=np.int16)  # longest piece by its first 4 bytes
        for _, body in found:
            if len(body) >= 4:
                spot = int(self._hash(body[:4]) & U(_FILTER))
                self.reach[spot] = max(self.reach[spot], len(body))
        sizes = np.array([len(t) for t in self.text], dtype=np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(self.text), dtype=np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in `ids` of hashes; -1 where there is no piece."""
        place = (h & U(_FILTER)).astype(np.int64)
        spot = self.slot[place]
        wrong = np.flatnonzero((spot >= 0) & (self.hashes[spot] != h))
        spot[wrong] = -1
        again = wrong[self.crowded[place[wrong]]]
        if len(again):
            other = np.minimum(np.searchsorted(self.hashes, h[again]), len(self.hashes) - 1)
            spot[again] = np.where(self.hashes[other] == h[again], other, -1)
        return spot

    @staticmethod
    def _hash(body: bytes) -> np.uint64:
        codes = _CODE[np.frombuffer(body, dtype=np.uint8)]
        with np.errstate(over="ignore"):
            powers = np.multiply.accumulate(np.r_[U(1), np.full(len(body) - 1, _BASE)]) if len(body) > 1 else np.array([U(1)])
            return mix(np.array([(codes * powers).sum(dtype=np.uint64)]))[0]


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattice:
    """The lattices of many units, laid end to end; `raw` are their bytes, `cuts` their bounds."""

    def __init__(self, v: Vocabulary, raw: np.ndarray, cuts: np.ndarray):
        n_units = len(cuts) - 1
        self.base = cuts[:-1] + np.arange(n_units)
        self.end = cuts[1:] + np.arange(n_units)
        unit = np.repeat(np.arange(n_units), np.diff(cuts))
        stop = cuts[1:][unit]
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.r_[U(1), np.full(max(0, len(raw) - 1), _BASE)])
            back = np.multiply.accumulate(np.r_[U(1), np.full(max(0, len(raw) - 1), _BACK)])
            total = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum(_CODE[raw] * power[: len(raw)], out=total[1:])
        lead = (raw & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        width = np.zeros(len(raw), dtype=np.int64)
        width[at] = np.diff(np.r_[at, len(raw)])
        alone = np.zeros(len(raw), dtype=bool)
        starts, sizes, pieces = [], [], []
        far, reach = at, None
        if len(v.lengths) and v.lengths[-1] >= 4:
            far = at[at + 4 <= stop[at]]
            with np.errstate(over="ignore"):
                reach = v.reach[(mix((total[far + 4] - total[far]) * back[far]) & U(_FILTER)).astype(np.int64)]
            reach = np.minimum(reach, stop[far] - far)
            far, reach = far[reach >= 4], reach[reach >= 4]
        for length in v.lengths:
            s = at[at + length <= stop[at]] if length < 4 else far[reach >= length]
            with np.errstate(over="ignore"):
                h = mix((total[s + length] - total[s]) * back[s])
            spot = v.find(h)
            s, spot = s[spot >= 0], spot[spot >= 0]
            alone[s[width[s] == length]] = True
            starts.append(s)
            sizes.append(np.full(len(s), length))
            pieces.append(v.ids[spot])
        owner = at[np.cumsum(lead) - 1] if len(raw) else at
        bare = np.flatnonzero(~alone[owner]) if len(raw) else at  # bytes of characters without a piece
        starts.append(bare)
        sizes.append(np.ones(len(bare), dtype=np.int64))
        pieces.append(v.byte_ids[raw[bare]])
        s, size, self.piece = np.concatenate(starts), np.concatenate(sizes), np.concatenate(pieces)
        place = s - cuts[unit[s]] + size
        self.source, target = s + unit[s], s + size + unit[s]
        order = np.argsort(target.astype(np.int32), kind="stable")
        self.source, target, self.piece, place = self.source[order], target[order], self.piece[order], place[order]
        nodes = len(raw) + n_units
        self.first = np.r_[0, np.cumsum(np.bincount(target, minlength=nodes))]
        # Forward sums, for the places 1, 2, ... of all units at a time.
        gain, forward = v.weight[self.piece], np.full(nodes, -np.inf)
        forward[self.base] = 0.0
        by_place = np.argsort(place.astype(np.int16) if place.max(initial=0) < 32_000 else place, kind="stable")
        bounds = np.searchsorted(place[by_place], np.arange(1, int(place.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            e = by_place[lo:hi]
            if not len(e):
                continue
            x, ends = forward[self.source[e]] + gain[e], target[e]
            new = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
            top = np.maximum.reduceat(x, new)
            top_of = np.repeat(top, np.diff(np.r_[new, len(e)]))
            forward[ends[new]] = np.where(top > -np.inf, top + np.log(np.add.reduceat(np.exp(np.where(top_of > -np.inf, x - top_of, -np.inf)), new)), -np.inf)
        share = np.exp(np.clip(forward[self.source] + gain - forward[target], -745, 0))
        share[~np.isfinite(forward[self.source])] = 0.0
        run = np.cumsum(share)
        new = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, dtype=np.int64)
        before = np.repeat(np.r_[0.0, run][new], np.diff(np.r_[new, len(target)]))
        self.upto = run - before
        if len(new):
            self.upto[np.r_[new[1:], len(target)] - 1] = 2.0

    def draw(self, unit: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, their number for each occurrence) of occurrences of units, each with a seed."""
        node, live = self.end[unit], np.arange(len(unit))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(unit), dtype=np.int64)
        base = self.base[unit]
        while len(live):
            with np.errstate(over="ignore"):
                x = (mix(seeds[live] + U(len(steps) + 1) * GOLDEN) >> U(11)) / 2.0**53
            edge = self.first[node]
            late = np.flatnonzero(x > self.upto[edge])
            while len(late):
                edge[late] += 1
                late = late[x[late] > self.upto[edge[late]]]
            steps.append((live, self.piece[edge]))
            counts[live] += 1
            node = self.source[edge]
            going = node != base[live]
            live, node = live[going], node[going]
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        for k, (who, piece) in enumerate(steps):
            out[ends[who] - 1 - k] = piece
        return out, counts


def _units(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the units of some texts (each begins with a space)."""
    space, line = raw == 0x20, raw == 0x0A
    start = line.copy()
    start[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
    start[offsets[:-1]] = True
    return np.flatnonzero(start)


def sample_batch(v: Vocabulary, keys: np.ndarray, texts: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the texts."""
    plain, offsets = text_buffer(texts)
    full = np.diff(offsets) > 0
    text = np.flatnonzero(full)
    if not len(text):
        return np.zeros(0, dtype=np.int32), np.zeros(len(keys) + 1, dtype=np.int64)
    raw = np.full(len(plain) + len(text), 0x20, dtype=np.uint8)
    rank = np.repeat(np.arange(len(text)), np.diff(offsets)[text])
    raw[np.arange(len(plain)) + rank + 1] = plain
    cuts = np.r_[offsets[:-1][text], len(plain)] + np.arange(len(text) + 1)
    begin = _units(raw, cuts)
    sizes = np.diff(np.r_[begin, len(raw)])
    with np.errstate(over="ignore"):
        place = np.arange(len(raw)) - np.repeat(begin, sizes)
        codes = _CODE[raw] * mix(place.astype(np.uint64) + U(77))
        name = mix(np.add.reduceat(codes, begin) + sizes.astype(np.uint64) * GOLDEN)
    _, one, kind = np.unique(name, return_index=True, return_inverse=True)
    bounds = np.r_[0, np.cumsum(sizes[one])]
    picked = raw[np.repeat(begin[one] - bounds[:-1], sizes[one]) + np.arange(bounds[-1])]
    lattice = Lattice(v, picked, bounds)
    owner = np.searchsorted(cuts, begin, side="right") - 1
    number = np.arange(len(begin)) - np.searchsorted(begin, cuts[:-1])[owner]
    with np.errstate(over="ignore"):
        seeds = mix(mix(keys[text].astype(np.int64).view(np.uint64) + U(seed) * GOLDEN)[owner] + number.astype(np.uint64) * U(0xD1342543DE82EF95))
    ids, counts = lattice.draw(kind.reshape(-1), seeds)
    per_text = np.zeros(len(keys), dtype=np.int64)
    per_text[text] = np.add.reduceat(counts, np.searchsorted(begin, cuts[:-1]))
    return ids, np.r_[0, np.cumsum(per_text)]


def decode_batch(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts of lists of ids, as strings."""
    sizes = v.sizes[ids]
    at = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    raw = v.bytes[np.repeat(v.starts[ids] - at, sizes) + np.arange(total)] if total else np.zeros(0, dtype=np.uint8)
    cuts = np.r_[at, total][offsets]
    drop = cuts[:-1][np.diff(cuts) > 0]  # the space put before each text
    keep = np.ones(total, dtype=bool)
    keep[drop] = False
    bounds = cuts - np.searchsorted(drop, cuts)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw[keep])]).cast(pa.string())


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", seed: int = 1, alpha: float = 1.0) -> DataFrame:
    """key, text and ids (array<int>): one sampled segmentation of each text."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, alpha)
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1)
            for a, b in slices(texts, 1 << 20):
                ids, offsets = sample_batch(v, keys[a:b], texts.slice(a, b - a), seed)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), texts.slice(a, b - a), lists], names=["id", "t", "ids"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return rows.mapInArrow(tidy(sampled), "id long, t string, ids array<int>").toDF(key, text, "ids")


def decode(coded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """coded with the text of its ids; null ids give null. A column called `to` is replaced."""
    ship(coded.sparkSession)
    kept = [c for c in coded.columns if c != to]
    schema = coded.select(*kept).schema.add(to, "string")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, 1.0)
        for batch in batches:
            lists = batch.column(kept.index(ids))
            mask = lists.is_null().to_numpy(zero_copy_only=False)
            sizes = np.where(mask, 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            offsets, flat = np.r_[0, np.cumsum(sizes)], np.asarray(lists.flatten())
            at = 0
            while at < len(lists):  # some 400,000 ids at a time
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 400_000, side="right")) - 1)
                texts = decode_batch(v, flat[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                if mask[at:end].any():
                    texts = pa.array([None if m else t for m, t in zip(mask[at:end], texts.to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in batch.columns), texts], names=[*kept, to])
                at = end

    return coded.select(*kept).mapInArrow(tidy(decoded), schema)
