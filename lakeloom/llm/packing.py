"""Best-fit packing of token ids into sequences of a fixed capacity.

Bounded-space online best fit: at most `open_bins` sequences are open at a time.
A bit set holds the sizes of free space for which some open sequence exists, so the
best fit is its lowest bit at or above the wanted length. If none fits and all bins
are in use, the fullest is closed. Pieces reach the packer in windows of
`window_tokens`, longest first within a window, which is what an online packer with a
bounded look-ahead may do. All happens in the task that tokenizes, without a shuffle;
a task leaves a few sequences unfilled, against thousands that it fills.

A null text counts as empty and gives the end id alone. A null id stays null.
Repeated rows are packed like different ones. An empty table gives an empty result.
Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy
from .tokens import encoder, tokenizer_path
from .words import slices

SCHEMA = "id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class BestFit:
    """place(length) -> (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self._free = [[] for _ in range(capacity + 1)]
        self._sizes, self._open, self.opened = 0, 0, 0

    def _take(self, free: int) -> int:
        bins = self._free[free]
        number = bins.pop()
        if not bins:
            self._sizes &= ~(1 << free)
        self._open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fitting = self._sizes >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self._open == self.open_bins:
                self._take((self._sizes & -self._sizes).bit_length() - 1)
            number, free = self.opened, self.capacity
            self.opened += 1
        offset, left = self.capacity - free, free - length
        if left:
            self._free[left].append(number)
            self._sizes |= 1 << left
            self._open += 1
        return number, offset


def _cut(data: bytes, capacity: int) -> list[tuple[int, bytes]]:
    """(piece, ids) of a document's packed ids; only longer ones are cut."""
    step = 4 * capacity
    return [(i // step, data[i : i + step]) for i in range(0, len(data), step)]


def _packed(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, open_bins: int, window_tokens: int) -> Iterator[pa.RecordBatch]:
    coder, packer = encoder(path, True), BestFit(capacity, open_bins)
    base = TaskContext.get().partitionId() << 40
    end = np.array([end_id], dtype="<u4").tobytes()
    waiting: list[tuple[int | None, int, bytes]] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        waiting.sort(key=lambda x: -len(x[2]))
        for at in range(0, len(waiting), 2000):
            some = waiting[at : at + 2000]
            spots = [packer.place(len(x[2]) // 4) for x in some]
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in some], pa.int64()),
                pa.array([x[1] for x in some], pa.int32()),
                pa.array([x[1] * capacity for x in some], pa.int64()),
                pa.array([len(x[2]) // 4 for x in some], pa.int64()),
                pa.array([x[2] for x in some], pa.binary()),
                pa.array([base + number for number, _ in spots], pa.int64()),
                pa.array([offset for _, offset in spots], pa.int64()),
            ], names=["id", "piece", "start", "length", "ids", "sequence_id", "offset"])
        waiting.clear()

    for batch in batches:
        texts = batch.column(1).fill_null("")
        for a, b in slices(texts):
            coded = coder.encode(texts.slice(a, b - a).cast(pa.binary()).to_pylist())
            for key, data in zip(batch.column(0).slice(a, b - a).to_pylist(), coded, strict=True):
                waiting.extend((key, piece, ids) for piece, ids in _cut(data + end, capacity))
                held += len(data) // 4 + 1
            if held >= window_tokens:
                yield from flush()
                held = 0
    yield from flush()


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, open_bins: int = 4096, window_tokens: int = 2_000_000) -> DataFrame:
    """One row per piece: key, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    ship(docs.sparkSession)
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return rows.mapInArrow(tidy(lambda b: _packed(b, path, capacity, end_id, open_bins, window_tokens)), SCHEMA).withColumnRenamed("id", key)
