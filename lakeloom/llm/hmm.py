"""Language-model scores of texts by a hidden Markov model whose states emit words.

A text is its words (A-Z lower-cased) and one end. Words are hashed to 64 bits; the top
CLASS_BITS bits are the word's class, the end has a class of its own. Every training word has
emissions of its own, expected counts per (word, state) in a distributed table with no bound
on its rows. Classes serve to start them and as back-off (see Emissions):

    P(word | state) = (kept counts + back-off * P(class | state) * P(word | class)) / total
    P(word | class) = (c + 1) / (N_class + V_class + 1), as the base does for the corpus

Reading. Texts are hashed once. Chunks of some CHUNK bytes of text are written as rows with the
distinct words of the chunk and each token's place among them; all later passes read these.

Training. All passes cover all training texts in full. The states start as the kinds of a
mixture that draws whole texts, the likeliest of a few. Baum-Welch passes
over classes then run until one gains less than `least_gain` (base 10 logarithm) a token; a
last pass adds up expected emissions by word. Forward and backward recursions are vectorised
over stretches of texts. A text longer than STRETCH is joined over its stretches by the
exact transfer matrix of each, so that results do not depend on STRETCH.

Scoring runs the scaled forward recursion over whole texts, so likelihoods are exact. Words
reach texts in two ways: the commonest word of each of HEAD slots through a broadcast table,
all others through a join of (block of chunks, word) pairs with the table of words. A word's
shares of states are kept in 16 bits each; totals are taken over the shares as kept.

Null and empty texts are the end alone. Rows without an id are scored but never teach. Repeated
rows each count and are each scored; there are no ties to break but between equally common
words of a slot, of which the one with the greatest hash is taken. A very long text is a chunk of its own, and takes
some 40 bytes a byte of it while it is hashed. Without training texts all probabilities are
those of an empty corpus. An empty table gives an empty result. Only id and text are read, so
other columns cannot clash; the result's columns are fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, tidy
from .words import U, hash_words, mix, slices

CLASS_BITS = 16
END = 1 << CLASS_BITS  # the class of the end
CLASSES = END + 1
HEAD_BITS = 18
HEAD = 1 << HEAD_BITS
END_HASH = U(0xE4D0F7E87E0CE1D5)
CHUNK, BLOCK_CHUNKS = 4 << 20, 2
STRETCH, BATCH = 2048, 1 << 19  # tokens of a stretch, and of the stretches that are worked on together
COMMON = 512  # commonest classes of a chunk, for which a mixture takes products of matrices over a table of texts and classes
SCALED = 4  # forward variables are scaled at every fourth token: four emissions are far from the least double
UNIT = 1 << 10  # expected counts of words are added up as whole multiples of 1 / UNIT
SHARE = (1 << 16) - 1


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with the end's, offsets) of the texts."""
    parts = [hash_words(texts.slice(a, b - a)) for a, b in slices(texts, 2 << 20)]  # hashing takes some 40 bytes a byte
    counts = np.concatenate([p.counts for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    offsets = np.r_[0, np.cumsum(counts + 1)]
    hashes = np.full(offsets[-1], END_HASH, dtype=np.uint64)
    words = np.ones(len(hashes), dtype=bool)
    words[offsets[1:] - 1] = False
    hashes[words] = np.concatenate([p.hashes for p in parts]) if parts else np.zeros(0, dtype=np.uint64)
    return hashes, offsets


def classes_of(words: np.ndarray) -> np.ndarray:
    return np.where(words == END_HASH, END, (words >> U(64 - CLASS_BITS)).astype(np.int64))


@dataclass
class Chunk:
    """Some texts: their ids, which of them teach, the distinct words, and each token's word."""

    keys: pa.Array
    teaches: np.ndarray
    words: np.ndarray
    codes: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, keys: pa.Array | None = None, teaches: np.ndarray | None = None) -> Chunk:
        hashes, offsets = _tokens(texts)
        words, codes = np.unique(hashes, return_inverse=True)
        n = len(texts)
        return cls(pa.nulls(n, pa.int64()) if keys is None else keys, np.ones(n, dtype=bool) if teaches is None else teaches, words, codes.reshape(-1), offsets)

    def teaching(self) -> Chunk:
        """The same with only the texts that teach; words are kept."""
        if self.teaches.all():
            return self
        sizes = np.diff(self.offsets)
        return Chunk(self.keys.filter(pa.array(self.teaches)), self.teaches[self.teaches], self.words, self.codes[np.repeat(self.teaches, sizes)], np.r_[0, np.cumsum(sizes[self.teaches])])

    FIELDS = "block long, keys array<long>, teaches array<boolean>, sizes array<long>, words binary, codes binary"

    def row(self, block: int) -> pa.RecordBatch:
        planes = np.ascontiguousarray(self.codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)  # bytes of one weight together compress well
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (self.keys, pa.array(self.teaches), pa.array(np.diff(self.offsets)))]
        return pa.RecordBatch.from_arrays([pa.array([block]), *lists, pa.array([self.words.astype("<u8").tobytes()]), pa.array([planes.tobytes()])], names=["block", "keys", "teaches", "sizes", "words", "codes"])

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Iterator[tuple[int, Chunk]]:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            keys, teaches, sizes = (column[x][i].values for x in ("keys", "teaches", "sizes"))
            codes = np.frombuffer(column["codes"][i].as_buffer(), dtype=np.uint8).reshape(4, -1).T
            codes = np.ascontiguousarray(codes).view("<u4").reshape(-1).astype(np.int64)
            words = np.frombuffer(column["words"][i].as_buffer(), dtype="<u8")
            yield column["block"][i].as_py(), cls(keys, np.asarray(teaches.to_numpy(zero_copy_only=False), dtype=bool), words, codes, np.r_[0, np.cumsum(sizes.to_numpy(zero_copy_only=False))].astype(np.int64))


def chunked(docs: DataFrame, teaches: Column, key: str, text: str) -> DataFrame:
    """Chunk rows of all texts; at most BLOCK_CHUNKS of a task, one after the other, have one block number."""

    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            texts, flags = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(texts, CHUNK):
                yield Chunk.of(texts.slice(a, b - a), batch.column(0).slice(a, b - a), flags[a:b]).row((TaskContext.get().partitionId() << 32) + number // BLOCK_CHUNKS)
                number += 1

    taught = F.coalesce(teaches, F.lit(False)) & F.col(key).isNotNull()
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), taught.alias("y"))
    return stored(rows.mapInArrow(tidy(cut), Chunk.FIELDS), "chunks", "zstd")


# -- recursions -----------------------------------------------------------------------------


class Room:
    """Large arrays that one batch leaves to the next: fresh pages cost more than what is written to them."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        """An array of that shape with any content, until the same name is asked for again."""
        size = int(np.prod(shape))
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size)
        return self.held[name][:size].reshape(shape)

    def rows(self, name: str, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The rows of a table at codes, all of which it has."""
        return np.take(table, codes, axis=0, out=self(name, len(codes), table.shape[1]), mode="clip")

    def columns(self, name: str, table: np.ndarray) -> np.ndarray:
        """A table's columns, each in one piece; copied by blocks that stay in the cache."""
        out = self(name, table.shape[1], len(table))
        for a in range(0, len(table), 4096):
            out[:, a : a + 4096] = table[a : a + 4096].T
        return out


class _Stretches:
    """Some stretches, longest first, with their tokens in order of time: at each time, those that last so long."""

    def __init__(self, codes: np.ndarray, begin: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        begin, sizes = begin[self.order], sizes[self.order]
        self.n, longest = len(sizes), int(sizes.max(initial=0))
        self.live = np.searchsorted(-sizes, -np.arange(longest), side="left")
        self.at = np.r_[0, np.cumsum(self.live)]
        self.time = np.repeat(np.arange(longest), self.live)
        self.row = np.arange(self.at[-1]) - self.at[self.time]
        self.codes = codes[begin[self.row] + self.time]
        self.last = self.at[sizes - 1] + np.arange(self.n)

    def steps(self) -> Iterator[tuple[int, int, int]]:
        """(begin, begin of the time before, rows) of each time but the first."""
        return zip(self.at[1:-1].tolist(), self.at[:-2].tolist(), self.live[1:].tolist(), strict=True)


@dataclass
class Sums:
    """Expected counts, and in likelihood[0] the log10 likelihood of what they come from (mixtures side by side have one each)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    likelihood: np.ndarray

    @classmethod
    def zero(cls, k: int, rows: int = CLASSES) -> Sums:
        return cls(np.zeros(k), np.zeros((k, k)), np.zeros((rows, k), order="F"), np.zeros(k))  # counts come in state by state

    def chain(self, share: np.ndarray, weight: float) -> Chain:
        """Expected counts to probabilities; `weight` tokens spread like `share` are added to each state."""
        emit = self.emit + weight * share[:, None]
        return Chain((self.start + 1) / (self.start + 1).sum(), (self.move + 1) / (self.move + 1).sum(axis=1, keepdims=True), np.ascontiguousarray(emit / emit.sum(axis=0)))


@dataclass
class Chain:
    """start (K), move (K, K), emit (rows, K): by class, or by whatever the codes of a call stand for."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def transfer(self, codes: np.ndarray, begin: np.ndarray, sizes: np.ndarray, room: Room) -> np.ndarray:
        """A matrix for each stretch, up to a factor: from the state at its first token, before it is seen, to that at its last, after."""
        s, k = _Stretches(codes, begin, sizes), len(self.start)
        emits = room.rows("emits", self.emit, s.codes)
        out = np.eye(k) * emits[: s.n, None, :]
        rows, grown = out.reshape(-1, k), np.empty((s.n * k, k))
        for t, (at, _, m) in enumerate(s.steps(), 1):
            np.matmul(rows[: m * k], self.move, out=grown[: m * k])
            np.multiply(grown[: m * k].reshape(m, k, k), emits[at : at + m, None, :], out=out[:m])
            if t % 8 == 0:
                out[:m] /= out[:m].max(axis=(1, 2))[:, None, None]
        back = np.empty_like(out)
        back[s.order] = out
        return back

    def _batches(self, codes: np.ndarray, offsets: np.ndarray, room: Room, backward: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
        """Stretches of some BATCH tokens: (text, begin, size, first, enter, before, leave).

        enter is the state's distribution before a stretch, before that at the last token of
        the stretch before, leave the backward variable at the stretch's last token, up to a factor.
        Without `backward` leave is not worked out, so that the last stretch of a text needs no matrix.
        """
        size, k = np.diff(offsets), len(self.start)
        parts = -(-size // STRETCH)
        text = np.repeat(np.arange(len(size)), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = offsets[:-1][text] + number * STRETCH
        sizes = np.minimum(STRETCH, offsets[1:][text] - begin)
        enter, before, leave = np.tile(self.start, (len(text), 1)), np.zeros((len(text), k)), np.ones((len(text), k))
        long = np.flatnonzero(parts[text] > 1)
        if len(long):
            last = number[long] == parts[text[long]] - 1
            wanted = long if backward else long[~last]
            matrices = np.empty((len(long), k, k))
            matrices[backward | ~last] = np.concatenate([self.transfer(codes, begin[wanted[a:b]], sizes[wanted[a:b]], room) for a, b in _runs(sizes[wanted])])
            held = self.start
            for i, m, ends in zip(long.tolist(), matrices, last.tolist(), strict=True):
                if number[i]:
                    before[i], enter[i] = held, held @ self.move
                if not ends:
                    held = enter[i] @ m
                    held = held / held.sum()
            for j in range(len(long) - 1, 0, -1) if backward else ():
                i = long[j]
                if number[i]:
                    back = self.move @ (matrices[j] @ leave[i])
                    leave[i - 1] = back / back.sum()
        order = np.argsort(-sizes, kind="stable")
        for a, b in _runs(sizes[order]):
            i = order[a:b]
            yield text[i], begin[i], sizes[i], number[i] == 0, enter[i], before[i], leave[i]

    def _forward(self, s: _Stretches, enter: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scaled forward variables, emissions over scales, log10 likelihood of each stretch) in the order of s."""
        emits, ones, logs = room.rows("emits", self.emit, s.codes), np.ones(len(self.start)), np.zeros(s.n)
        alpha = room("alpha", *emits.shape)

        def scale(at: int, m: int) -> None:
            now = alpha[at : at + m]
            total = now @ ones
            logs[:m] += np.log10(total)
            inverse = (1 / total)[:, None]
            now *= inverse
            emits[at : at + m] *= inverse

        np.multiply(enter[s.order], emits[: s.n], out=alpha[: s.n])
        scale(0, s.n)
        for t, (at, prior, m) in enumerate(s.steps(), 1):
            now = alpha[at : at + m]
            np.matmul(alpha[prior : prior + m], self.move, out=now)
            now *= emits[at : at + m]
            if t % SCALED == 0:
                scale(at, m)
        return alpha, emits, logs + np.log10(alpha[s.last] @ ones)

    def likelihood(self, codes: np.ndarray, offsets: np.ndarray, room: Room | None = None) -> np.ndarray:
        """log10 P of each sequence, by the scaled forward recursion; none may be empty."""
        out, room = np.zeros(len(offsets) - 1), room or Room()
        for text, begin, sizes, _, enter, _, _ in self._batches(codes, offsets, room, backward=False):
            s = _Stretches(codes, begin, sizes)
            out += np.bincount(text[s.order], weights=self._forward(s, enter, room)[2], minlength=len(out))
        return out

    def expect(self, codes: np.ndarray, offsets: np.ndarray, sums: Sums, room: Room | None = None) -> None:
        """Add the expected counts of whole texts."""
        against, room = np.ascontiguousarray(self.move.T), room or Room()
        for _, begin, sizes, first, enter, before, leave in self._batches(codes, offsets, room):
            s = _Stretches(codes, begin, sizes)
            alpha, emits, logs = self._forward(s, enter, room)
            sums.likelihood[0] += logs.sum()
            leave = leave[s.order]
            beta = leave / (alpha[s.last] * leave).sum(axis=1, keepdims=True)  # of a stretch at the time in hand; at its last token until then
            moved, held = np.zeros_like(self.move), np.empty_like(beta)
            for at, prior, m in reversed(list(s.steps())):
                now, ahead, here = beta[:m], held[:m], slice(at, at + m)
                np.multiply(emits[here], now, out=ahead)
                alpha[here] *= now  # no step needs it any more
                np.matmul(ahead, against, out=now)
                moved += alpha[prior : prior + m].T @ ahead
            inside = ~first[s.order]
            moved += before[s.order][inside].T @ (emits[: s.n] * beta)[inside]
            sums.move += moved * self.move
            alpha[: s.n] *= beta
            sums.start += alpha[: s.n][~inside].sum(axis=0)
            for i, post in enumerate(room.columns("emits", alpha)):  # the emissions are done with
                sums.emit[:, i] += np.bincount(s.codes, weights=post, minlength=len(sums.emit))


def _runs(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges that hold some BATCH tokens each."""
    run = np.cumsum(sizes) // BATCH
    cuts = np.r_[0, np.flatnonzero(np.diff(run)) + 1, len(sizes)]
    return [(int(a), int(b)) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


# -- training passes ------------------------------------------------------------------------


def add_chunk(chain: Chain, chunk: Chunk, sums: Sums, room: Room | None = None) -> None:
    """Add a chunk's expected counts by class."""
    chain.expect(classes_of(chunk.words)[chunk.codes], chunk.offsets, sums, room)


def _pass(chunks: DataFrame, k: int, add) -> Sums:
    """Sums over all chunks of texts that teach, by add(chunk, sums, room)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_rows, room = Sums.zero(k), False, Room()
        for batch in batches:
            for _, chunk in Chunk.read(batch):
                if chunk.teaches.any():
                    any_rows = True
                    add(chunk.teaching(), sums, room)
        if any_rows:  # rows -1 - i: starts, transitions from i - 1, then the likelihood
            table = np.vstack([sums.emit, sums.start[None, :], sums.move, sums.likelihood[None, :]])
            numbers = np.concatenate([np.arange(CLASSES), -1 - np.arange(k + 2)])
            held = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[held].astype(np.int32)), *(pa.array(table[held, i]) for i in range(k))], names=["row", *(f"s{i}" for i in range(k))])

    rows = chunks.select("block", "keys", "teaches", "sizes", "words", "codes").mapInArrow(tidy(counted), "row int, " + ", ".join(f"s{i} double" for i in range(k)))
    held = rows.groupBy("row").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]).toArrow()  # at most CLASSES + k + 2 rows
    table = np.zeros((CLASSES + k + 2, k))
    number = held["row"].to_numpy()
    table[np.where(number >= 0, number, CLASSES - 1 - number)] = np.column_stack([held[f"s{i}"].to_numpy() for i in range(k)])
    return Sums(table[CLASSES], table[CLASSES + 1 : -1], table[:CLASSES], table[-1])


def class_signs(n: int) -> np.ndarray:
    """n pseudo-random signs for each class."""
    draws = [mix(np.arange(1, CLASSES + 1, dtype=np.uint64) + (U(i) << U(40))).view(np.uint8).reshape(-1, 8) for i in range(-(-n // 64))]
    return np.unpackbits(np.concatenate(draws, axis=1), axis=1)[:, :n] * 2.0 - 1


def add_mixture(logs: np.ndarray, prior: np.ndarray, starts: int, chunk: Chunk, sums: Sums) -> None:
    """Expected class counts of a mixture that draws each text whole from one state, for several mixtures side by side.

    A text's share in a state is left out of the state's class counts where it is below 1e-4.
    """
    tokens, sizes, k = classes_of(chunk.words)[chunk.codes], np.diff(chunk.offsets), len(prior) // starts
    width = min(COMMON, 2 * len(tokens) // len(sizes))  # so that the table is at most twice as long as the tokens
    common = np.argpartition(np.bincount(tokens, minlength=CLASSES), -width)[-width:]
    place = np.full(CLASSES, -1)
    place[common] = np.arange(width)
    at, text = place[tokens], np.repeat(np.arange(len(sizes)), sizes)
    rare = at < 0
    table = np.bincount((text * width + at)[~rare], minlength=len(sizes) * width).reshape(-1, width).astype(np.float64)
    tokens, text = tokens[rare], text[rare]
    fit = table @ logs[common] + prior
    for i, column in enumerate(np.ascontiguousarray(logs.T, dtype=np.float64)):  # a column at a time adds up far faster
        fit[:, i] += np.bincount(text, weights=column[tokens], minlength=len(sizes))
    fit = fit.reshape(-1, starts, k)
    top = fit.max(axis=2, keepdims=True)
    post = np.exp(fit - top)
    total = post.sum(axis=2, keepdims=True)
    sums.likelihood[:starts] += (top + np.log(total)).sum(axis=(0, 2)) / np.log(10)
    post = (post / total).reshape(-1, starts * k)
    sums.start += post.sum(axis=0)
    held = post >= 1e-4
    post[~held] = 0
    sums.emit[common] += (post.T @ table).T
    for i in range(starts * k):
        some = slice(None) if held[:, i].all() else held[:, i][text]
        sums.emit[:, i] += np.bincount(tokens[some], weights=post[:, i][text[some]], minlength=CLASSES)


def seed_sums(chunks: DataFrame, k: int, weight: float, starts: int, rounds: int) -> tuple[Sums, np.ndarray]:
    """Expected class counts of k kinds of texts, and all tokens by class.

    Each of `starts` mixtures begins with the corpus's shares, raised or lowered by a twentieth class by
    class, and takes `rounds` passes over all texts that teach; the likeliest is kept. How far the
    states lie apart at first does not depend on the number of texts.
    """

    def count(chunk: Chunk, sums: Sums, room: Room) -> None:
        sums.emit[:, 0] += np.bincount(classes_of(chunk.words), weights=np.bincount(chunk.codes, minlength=len(chunk.words)), minlength=CLASSES)

    size = _pass(chunks, 1, count).emit[:, 0]
    share = (size + 1) / (size + 1).sum()
    emit, prior = share[:, None] * np.exp(0.05 * class_signs(starts * k)), np.zeros(starts * k)
    sums = Sums.zero(starts * k)
    for _ in range(rounds if size.any() else 0):
        shared = chunks.sparkSession.sparkContext.broadcast((np.log(emit / emit.sum(axis=0)).astype(np.float32), prior))
        sums = _pass(chunks, starts * k, lambda chunk, sums, room, shared=shared: add_mixture(*shared.value, starts, chunk, sums))
        emit, prior = sums.emit + weight * share[:, None], np.log(sums.start + 1e-9)
    best = int(sums.likelihood[:starts].argmax())
    own = slice(best * k, best * k + k)
    return Sums(sums.start[own], np.zeros((k, k)), np.ascontiguousarray(sums.emit[:, own]), np.zeros(k)), size


def train(chunks: DataFrame, k: int, weight: float, least_gain: float, starts: int = 2, rounds: int = 4) -> tuple[Chain, list[float]]:
    """Baum-Welch passes until one gains less than least_gain a token; gives what each pass found the log10 likelihood a token to be."""
    seeds, size = seed_sums(chunks, k, weight, starts, rounds)
    share = (size + 1) / (size + 1).sum()
    chain = seeds.chain(share, weight)
    move = np.full((k, k), 0.05 / max(1, k - 1))
    np.fill_diagonal(move, 0.95 if k > 1 else 1.0)
    chain = Chain(chain.start, move, chain.emit)
    seen: list[float] = []
    while size.any():
        shared = chunks.sparkSession.sparkContext.broadcast(chain)
        sums = _pass(chunks, k, lambda chunk, sums, room, shared=shared: add_chunk(shared.value, chunk, sums, room))
        chain = sums.chain(share, weight)
        seen.append(float(sums.likelihood[0] / size.sum()))
        if len(seen) > 1 and seen[-1] - seen[-2] < least_gain:
            break
    return chain, seen


def word_states(chunks: DataFrame, chain: Chain) -> DataFrame:
    """h, c tokens, and shares of the states packed four a column w0.. : the expected counts of all words that teach."""
    k = len(chain.start)
    shared = chunks.sparkSession.sparkContext.broadcast(chain)
    names = [f"s{i}" for i in range(k)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, room = shared.value, Room()
        for batch in batches:
            for _, chunk in Chunk.read(batch):
                chunk = chunk.teaching()
                counts = np.bincount(chunk.codes, minlength=len(chunk.words))
                sums = Sums.zero(k, len(chunk.words))
                Chain(model.start, model.move, model.emit[classes_of(chunk.words)]).expect(chunk.codes, chunk.offsets, sums, room)
                held = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(chunk.words[held].view(np.int64)), pa.array(counts[held]), *(pa.array(np.rint(sums.emit[held, i] * UNIT).astype(np.int64)) for i in range(k))], names=["h", "c", *names])

    rows = chunks.select("block", "keys", "teaches", "sizes", "words", "codes").mapInArrow(tidy(counted), "h long, c long, " + ", ".join(f"{x} long" for x in names))
    summed = rows.groupBy("h").agg(*[F.sum(x).alias(x) for x in ("c", *names)])
    whole = F.greatest(sum((F.col(x) for x in names), F.lit(0)), F.lit(1))

    def packed(some: list[str]) -> Column:
        out = F.lit(0).cast("long")
        for i, x in enumerate(some):
            out = out.bitwiseOR(F.shiftleft(F.round(F.col(x) * SHARE / whole).cast("long"), 16 * i))
        return out

    return stored(summed.select("h", "c", *[packed(names[i : i + 4]).alias(f"w{i // 4}") for i in range(0, k, 4)]), "word-states")


def unpacked(words: list[np.ndarray], counts: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) expected counts from packed shares."""
    return np.column_stack([w.astype("<i8").view("<u2").reshape(-1, 4) for w in words])[:, :k] * (counts / SHARE)[:, None]


# -- the model ------------------------------------------------------------------------------


@dataclass
class Emissions:
    """P(word | state) / P(word | class) from a word's expected counts, backed off to its class.

    A word seen c times keeps c / (c + 1) of its expected counts; what is taken off and
    `weight` tokens go to the class model, so that the words of a state still sum to one.
    """

    emit: np.ndarray  # (CLASSES, K): of the classes
    class_size: np.ndarray  # N + V + 1 of each class; 1 for the end
    total: np.ndarray  # (K): expected tokens and weight
    back: np.ndarray  # (K): the class model's part

    def of(self, classes: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
        share = np.where(classes == END, 1.0, (counts + 1) / self.class_size[classes])
        return sums * (counts / (counts + 1) / share)[:, None] / self.total + self.back * self.emit[classes]


@dataclass
class Head:
    """The commonest word of each slot: hash, count, expected counts."""

    words: np.ndarray
    counts: np.ndarray
    sums: np.ndarray

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (words & U(len(self.words) - 1)).astype(np.int64)
        return slot, (self.words[slot] == words) & (self.counts[slot] > 0)


@dataclass
class Model:
    chain: Chain
    emissions: Emissions
    head: Head
    states: DataFrame  # h, c, w0..: all words that teach
    tokens: int
    vocabulary: int
    passes: list[float]  # log10 likelihood a token that each Baum-Welch pass over classes found
    chunks: DataFrame  # of the texts that the model was fitted over

    def score(self, docs: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
        """key, n_tokens, n_known, train_tokens, base_score, score; of the rows that the model was fitted over, or of docs."""
        k, tokens, spark = len(self.chain.start), self.tokens, self.states.sparkSession
        chunks = self.chunks if docs is None else chunked(docs, F.lit(False), key, text)
        base_log = float(np.log10(self.tokens + self.vocabulary + 1.0))
        shared = spark.sparkContext.broadcast((self.chain.start, self.chain.move, self.emissions, self.head))
        packs = [c for c in self.states.columns if c[0] == "w"]

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The words of each block that are not in the head."""
            head, block, held = shared.value[3], None, []

            def close() -> pa.RecordBatch:
                words = np.unique(np.concatenate(held))
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), pa.array(words.view(np.int64))], names=["block", "h"])

            for batch in batches:
                for i in range(batch.num_rows):
                    words = np.frombuffer(batch.column(1)[i].as_buffer(), dtype="<u8")
                    if batch.column(0)[i].as_py() != block:
                        if held:
                            yield close()
                        block, held = batch.column(0)[i].as_py(), []
                    held.append(words[~head.find(words)[1]])
            if held:
                yield close()

        def scored(texts: pa.Table, found: pa.Table) -> Iterator[pa.Table] | pa.Table:
            start, move, emissions, head = shared.value
            own, at = np.unique(found["h"].to_numpy().view(np.uint64), return_index=True)
            own_counts = found["c"].to_numpy()[at]
            own_sums = unpacked([found[w].to_numpy()[at] for w in packs], own_counts, k)
            out, room = [], Room()
            for batch in texts.to_batches():
                for _, chunk in Chunk.read(batch):
                    words, kinds = chunk.words, classes_of(chunk.words)
                    slot, common = head.find(words)
                    counts, sums = np.where(common, head.counts[slot], 0), np.where(common[:, None], head.sums[slot], 0.0)
                    if len(own):
                        place = np.minimum(np.searchsorted(own, words), len(own) - 1)
                        rare = (own[place] == words) & ~common
                        counts[rare], sums[rare] = own_counts[place[rare]], own_sums[place[rare]]
                    model = Chain(start, move, emissions.of(kinds, counts, sums))
                    logs, first, n = np.log10(counts + 1.0), chunk.offsets[:-1], np.diff(chunk.offsets)
                    inner = np.where(kinds == END, 0.0, logs - np.log10(emissions.class_size[kinds]))
                    out.append((
                        chunk.keys, n,
                        np.add.reduceat((counts > 0)[chunk.codes].astype(np.int64), first),
                        np.add.reduceat(logs[chunk.codes], first) - n * base_log,
                        np.add.reduceat(inner[chunk.codes], first) + model.likelihood(chunk.codes, chunk.offsets, room),
                    ))
            keys, n, known, base, score = zip(*out, strict=True) if out else ([],) * 5
            pa.default_memory_pool().release_unused()
            number = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
            return pa.table({
                key: pa.chunked_array([pa.concat_arrays(keys)] if keys else [], pa.int64()),
                "n_tokens": number(n, pa.int64()),
                "n_known": number(known, pa.int64()),
                "train_tokens": pa.array(np.full(sum(map(len, n)), tokens), pa.int64()),
                "base_score": number(base, pa.float64()),
                "score": number(score, pa.float64()),
            })

        pairs = chunks.select("block", "words").mapInArrow(tidy(rest), "block long, h long")
        found = pairs.join(self.states, "h").select("block", "h", "c", *packs)
        schema = f"{key} long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return chunks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(scored, schema)


def fit(docs: DataFrame, teaches: Column, key: str = "doc_id", text: str = "text", states: int = 8, weight: float = 10_000.0, least_gain: float = 0.002) -> Model:
    """Baum-Welch over the rows for which `teaches` holds, until a pass gains less than least_gain (log10) a token."""
    ship(docs.sparkSession)
    chunks = chunked(docs, teaches, key, text)
    chain, passes = train(chunks, states, weight, least_gain)
    held = word_states(chunks, chain)
    end = int(END_HASH.view(np.int64))
    packs = [c for c in held.columns if c[0] == "w"]
    share = [F.shiftrightunsigned(f"w{i // 4}", 16 * (i % 4)).bitwiseAND(F.lit(SHARE)) * F.col("c") / SHARE for i in range(states)]
    sizes = held.agg(F.sum("c"), F.count("*"), *[F.sum(x) for x in share], *[F.sum(x / (F.col("c") + 1)) for x in share]).first()
    tokens, vocabulary = int(sizes[0] or 0), int(sizes[1])
    total, taken = np.array([x or 0.0 for x in sizes[2:]]).reshape(2, states)
    of_words = held.filter(F.col("h") != end)
    by_class = of_words.groupBy(F.shiftrightunsigned("h", 64 - CLASS_BITS).cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()  # at most CLASSES rows
    class_size = np.ones(CLASSES)
    class_size[by_class["k"].to_numpy()] += by_class["n"].to_numpy() + by_class["v"].to_numpy()
    emissions = Emissions(chain.emit, class_size, total + weight, (taken + weight) / (total + weight))
    top = held.groupBy(F.col("h").bitwiseAND(F.lit(HEAD - 1)).cast("int").alias("slot")).agg(F.max(F.struct("c", "h", *packs)).alias("x")).select("slot", "x.*").toArrow()  # at most HEAD rows
    head, slots = Head(np.zeros(HEAD, dtype=np.uint64), np.zeros(HEAD, dtype=np.int64), np.zeros((HEAD, states))), top["slot"].to_numpy()
    if len(top):
        counts = top["c"].to_numpy()
        head.words[slots], head.counts[slots], head.sums[slots] = top["h"].to_numpy().view(np.uint64), counts, unpacked([top[w].to_numpy() for w in packs], counts, states)
    return Model(chain, emissions, head, held, tokens, vocabulary, passes, chunks)
