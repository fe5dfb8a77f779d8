"""Toxicity by maximum-scoring segments over token log-odds.

Learning. Words (runs of letters and digits, A-Z lower-cased) are hashed to BUCKETS places. One pass over all
documents counts the words of each place in the corpus, and the toxic and the clean
training rows that hold it (rows, since a word that one row repeats is one piece of
evidence; and toxic rows no more than the different words found before it, which a 64-bit
sketch counts, since the words of a text that is copied are one piece of evidence too). The log-odds of a place compare its rows with the rows without it, class against
class, under a Dirichlet prior of `prior_flat` for either outcome, to which the first adds
`prior_corpus` shared out like the corpus counts; a place whose log-odds exceed `least_odds` and `least_z` standard errors gets
them as its weight, all others weigh -drift. The weights are one dense table of
BUCKETS floats (4 MB), which bounds what is broadcast whatever the corpus holds.

Scoring. All maximal scoring segments of a text (Ruzzo and Tompa) are found in one scan
of its weighted words. By Karlin and Altschul, the best segment of a clean text of n words
exceeds S with probability 1 - exp(-K n exp(-lambda S)): lambda solves
sum p exp(lambda s) = 1 over clean words, K is fitted to the best segments of clean
training rows. Segments with a probability of at most `significance` are the passages
reported. The text's score is a logistic function of the excess lambda S - log(K n) of its
best segment and of the sum over segments, fitted on training rows, each scored with weights
from which its own count is taken away.

Training rows are labelled rows that pass the caller's filter, at most `most_labelled` of
them, those with the least hash of their id; rows beyond are counted as corpus only.

Null and empty texts have no words and get the score of a text without any toxic word.
Null labels and labels without a document teach nothing; without toxic and clean training
rows all scores are 0. Null ids and repeated rows are scored like others; an empty table
gives an empty result; only the id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, ship, stored, thin, tidy
from .words import U, hash_words, mix, slices

BITS = 20
BUCKETS = 1 << BITS
LOW = -15.0


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, corpus, toxic, clean) sums of a task's rows (text, label); place -1 counts the rows."""
    sums, contexts = np.zeros((3, BUCKETS), dtype=np.int64), np.zeros(BUCKETS, dtype=np.uint64)
    texts_of = [0, 0, 0]
    for batch in batches:
        texts, labels = batch.column(0), batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
        texts_of = [texts_of[0] + len(labels), texts_of[1] + int((labels == 1).sum()), texts_of[2] + int((labels == 0).sum())]
        for a, b in slices(texts):
            words = hash_words(texts.slice(a, b - a), letters=True)
            places, rows = _places(words.hashes), np.repeat(np.arange(a, b), words.counts)
            sums[0] += np.bincount(places, minlength=BUCKETS)
            for row, label in ((1, 1), (2, 0)):
                own = labels[rows] == label
                if own.any():  # each place once a text
                    held = np.unique(rows[own] * BUCKETS + places[own])
                    sums[row] += np.bincount(held % BUCKETS, minlength=BUCKETS)
                    if label:
                        before = np.r_[U(0), words.hashes[:-1]]
                        before[words.offsets[:-1][words.counts > 0]] = 0
                        np.bitwise_or.at(contexts, places[own], U(1) << (mix(before[own]) >> U(58)))
    if texts_of[0]:
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([n], pa.int64()) for n in [*texts_of, 0])], names=["place", "corpus", "toxic", "clean", "contexts"])
    held = np.flatnonzero(sums[0])
    for at in range(0, len(held), 50_000):
        some = held[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(s[some]) for s in [*sums, contexts.view(np.int64)])], names=["place", "corpus", "toxic", "clean", "contexts"])


def segments(at: list[int], weight: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence.

    Its elements weigh -drift, but for those at the rising positions `at`, which have a
    positive weight. Time is linear in their number: each candidate remembers the last
    candidate before it that begins lower.
    """
    starts: list[int] = []
    ends: list[int] = []
    left: list[float] = []
    right: list[float] = []
    lower: list[int] = []
    total, after = 0.0, 0
    for p, w in zip(at, weight, strict=True):
        total -= drift * (p - after)
        start, lo = p, total
        total += w
        hi, after = total, p + 1
        while True:
            j = len(starts) - 1
            while j >= 0 and left[j] >= lo:
                j = lower[j]
            if j < 0 or right[j] >= hi:
                break
            start, lo = starts[j], left[j]
            for held in (starts, ends, left, right, lower):
                del held[j:]
        starts.append(start)
        ends.append(after)
        left.append(lo)
        right.append(hi)
        lower.append(j)
    return [(s, e, h - x) for s, e, x, h in zip(starts, ends, left, right, strict=True)]


@dataclass(frozen=True)
class Calibration:
    """Karlin-Altschul parameters and the logistic weights (constant, best, sum)."""

    scale: float = 1.0
    log_k: float = 0.0
    logistic: tuple[float, float, float] = (0.0, 0.0, 0.0)
    trained: bool = False

    def excess(self, score: float, n: int) -> float:
        return self.scale * score - self.log_k - math.log(max(n, 1))

    def chance(self, score: float, n: int) -> float:
        """That a clean text of n words has a segment as good."""
        return -math.expm1(-math.exp(min(50.0, -self.excess(score, n))))

    def features(self, found: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        over = [self.excess(s, n) for _, _, s in found]
        best = max(over, default=LOW)
        return min(60.0, max(LOW, best)), math.log1p(sum(x for x in over if x > 0))

    def score(self, features: tuple[float, float]) -> float:
        if not self.trained:
            return 0.0
        a, b, c = self.logistic
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * features[0] + c * features[1]))))


def _scan(texts: pa.Array, weights: np.ndarray, drift: float) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(words, segments) of each text."""
    for a, b in slices(texts):
        words = hash_words(texts.slice(a, b - a), letters=True)
        w = weights[_places(words.hashes)]
        hits = np.flatnonzero(w > 0)
        cuts = np.searchsorted(hits, words.offsets)
        for i in range(b - a):
            own = hits[cuts[i] : cuts[i + 1]]
            yield int(words.offsets[i + 1] - words.offsets[i]), segments((own - words.offsets[i]).tolist(), w[own].tolist(), drift)


@dataclass(frozen=True)
class Options:
    prior_flat: float = 0.5
    prior_corpus: float = 10.0
    least_z: float = 3
    least_odds: float = 2.0
    drift: float = 0.25
    most_weight: float = 8.0
    significance: float = 0.01
    most_labelled: int = 50_000


def _tables(cells: DataFrame, o: Options) -> tuple[np.ndarray, float]:
    """Dense tables of weights and lambda.

    The first row weighs any text. The others are for training texts, toxic and clean:
    as if the text at hand had not been counted, so that calibration sees how far a weight
    holds beyond the rows that it was learned from.
    """
    tables = np.full((3, BUCKETS), -o.drift, dtype=np.float32)
    count = cells.filter("place < 0").first()
    cells = cells.filter("place >= 0")
    total = cells.agg(F.sum("corpus"), F.sum("clean")).first()
    corpus, clean = (float(x or 0) for x in total)
    if not count or not count["toxic"] or not count["clean"] or not clean:
        return tables, 0.0
    prior = F.col("corpus") * (o.prior_corpus / corpus) + o.prior_flat
    held_bits = F.bit_count("contexts")
    varied = F.when(held_bits < 60, F.round(-64 * F.log(1 - held_bits / 64))).otherwise(F.col("toxic"))
    cells = cells.withColumn("toxic", F.least(F.col("toxic"), varied.cast("long")))

    def weight(less_toxic: int, less_clean: int) -> Column:
        toxic, fine = F.greatest(F.col("toxic") - less_toxic, F.lit(0)), F.greatest(F.col("clean") - less_clean, F.lit(0))
        t, c = toxic + prior, fine + prior
        no_t, no_c = float(count["toxic"]) - less_toxic - toxic + o.prior_flat, float(count["clean"]) - less_clean - fine + o.prior_flat
        odds = F.log(t / no_t) - F.log(c / no_c)
        z = odds / F.sqrt(1 / t + 1 / c + 1 / no_t + 1 / no_c)
        return F.when((z >= o.least_z) & (odds >= o.least_odds), F.least(odds, F.lit(o.most_weight))).otherwise(-o.drift)

    rows = cells.filter("toxic > 0").select("place", "clean", weight(0, 0).alias("w0"), weight(1, 0).alias("w1"), weight(0, 1).alias("w2"))
    held = rows.filter("w0 > 0 or w1 > 0 or w2 > 0").toPandas()  # at most BUCKETS rows
    place = held.place.to_numpy()
    for row in range(3):
        tables[row, place] = held[f"w{row}"].to_numpy()
    # Under the clean rows' own weights; a place that only toxic rows hold has no share there.
    share, worth = held.clean.to_numpy() / clean, tables[2, place].astype(np.float64)
    rest = 1.0 - share.sum()

    def moment(x: float) -> float:
        return float((share * np.exp(x * worth)).sum() + rest * math.exp(-x * o.drift)) - 1.0

    low, high = 1e-9, 20.0
    if moment(1e-6) >= 0:  # clean words rise on average: no scale exists, segments are taken as they are
        return tables, 1e-3
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 0 else (low, middle)
    return tables, min(high, 3.0)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps with a small ridge; x has two columns."""
    full, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + ridge, full.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


@dataclass
class Model:
    weights: np.ndarray
    calibration: Calibration
    options: Options

    def apply(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """key, score, predicted, n_words and passages: the significant segments, as word positions."""
        ship(docs.sparkSession)
        shared = docs.sparkSession.sparkContext.broadcast((self.weights, self.calibration, self.options))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, calibration, o = shared.value
            passage = pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("chance", pa.float64())])
            for batch in batches:
                sizes, scores, passages = [], [], []
                for n, found in _scan(batch.column(1), weights, o.drift):
                    sizes.append(n)
                    scores.append(calibration.score(calibration.features(found, n)))
                    passages.append([{"start_word": s, "end_word": e, "score": x, "chance": p} for s, e, x in found if (p := calibration.chance(x, n)) <= o.significance])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(sizes, pa.int32()), pa.array(passages, pa.list_(passage))], names=["id", "score", "predicted", "n_words", "passages"])

        schema = "id long, score double, predicted int, n_words int, passages array<struct<start_word:int,end_word:int,score:double,chance:double>>"
        return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(tidy(scored), schema).withColumnRenamed("id", key)


    def keep(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows of docs that are not predicted toxic, with all their columns."""
        ship(docs.sparkSession)
        shared = docs.sparkSession.sparkContext.broadcast((self.weights, self.calibration, self.options))
        at = docs.columns.index(text)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, calibration, o = shared.value
            for batch in thin(batches):
                fine = [calibration.score(calibration.features(found, n)) < 0.5 for n, found in _scan(batch.column(at).cast(pa.string()), weights, o.drift)]
                yield batch.filter(pa.array(fine, pa.bool_()))

        return docs.mapInArrow(tidy(kept), docs.schema)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", teaches: Column | None = None, options: Options | None = None) -> Model:
    """Learn from the labelled rows for which `teaches` (over the key) holds."""
    o = options or Options()
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(key).cast("long").alias("_k"), F.col(label).cast("int").alias("_y")).filter("_k is not null and _y in (0, 1)")
    known = known.groupBy("_k").agg(F.max("_y").alias("_y"))
    if teaches is not None:
        known = known.withColumnRenamed("_k", key).filter(teaches).withColumnRenamed(key, "_k")
    sample = stored(least_hashed(known, "_k", o.most_labelled, known.count()), "toxic-labels")  # bounded, so broadcast below
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).cast("string").alias("_t"))
    cells = rows.join(F.broadcast(sample), "_k", "left").select("_t", "_y").mapInArrow(tidy(_counted), "place int, corpus long, toxic long, clean long, contexts long")
    cells = stored(cells.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("corpus", "toxic", "clean")], F.bit_or("contexts").alias("contexts")), "toxic-counts")
    tables, scale = _tables(cells, o)
    weights = tables[0].copy()
    if not scale:
        return Model(weights, Calibration(), o)
    shared = spark.sparkContext.broadcast(tables[1:])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None] * batch.num_rows
            for row, label in enumerate((1, 0)):
                at = np.flatnonzero(batch.column(2).to_numpy() == label)
                for i, x in zip(at.tolist(), _scan(batch.column(0).take(pa.array(at)), shared.value[row], o.drift), strict=True):
                    found[i] = x
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([n for n, _ in found], pa.int32()), pa.array([[s for _, _, s in f] for _, f in found], pa.list_(pa.float64()))], names=["k", "y", "n", "scores"])

    seen = rows.join(F.broadcast(sample), "_k").select("_t", "_k", "_y").mapInArrow(tidy(best), "k long, y int, n int, scores array<double>")
    seen = seen.groupBy("k").agg(F.max(F.struct("n", "scores", "y")).alias("x")).select("x.*").toPandas()  # one row an id, so at most most_labelled
    y, n = seen.y.to_numpy(), np.maximum(seen.n.to_numpy(), 1)
    top = np.array([max(s, default=0.0) for s in seen.scores])
    clean = scale * top[y == 0] - np.log(n[y == 0])
    rough = Calibration(scale, float(clean.mean()) - 0.5772 if len(clean) else 0.0)  # a Gumbel variable's mean is log K + 0.5772
    x = np.array([rough.features([(0, 0, s) for s in scores], int(m)) for scores, m in zip(seen.scores, n, strict=True)]).reshape(-1, 2)
    both = bool(0 < y.sum() < len(y))
    return Model(weights, Calibration(scale, rough.log_k, _logistic(x, y) if both else (0.0, 0.0, 0.0), both), o)
