"""Near-duplicate groups: SuperMinHash, banding, verification on full sets, components.

1. Texts with equal shingle sets form a class; its least id stands for it.
2. The signatures of these representatives are cut into bands. All that share a band
   key meet in a bucket, and each is compared with the bucket's leader only: the text
   that meets most others over all its buckets, so the least altered of a group of copies; of several the
   one of least id.
3. Pairs whose signatures agree in enough places are confirmed on the full shingle
   sets, and components are formed.
4. A bucket whose rows now lie in one component needs no more. In any other, every row's exact
   distance (1 - similarity) to the leader is taken. Distances obey the triangle inequality, so a row outside the leader's
   component can be linked with a row inside only where their distances to the leader differ by no more than the
   greatest distance of a link; rows for which no partner is left drop out. The others
   are compared in full: blocks meet in one task each, signatures first, then full sets, and what leaves the
   task is at most one confirmed link for each row and component. A pair that shares several bands is compared in
   the first of them only.
5. The rows outside get a leader of their own, and so on, LEVELS times, each at a cost that is linear in the rows left.
   What is outside still is compared in blocks, all with all of other components.

So no two rows of a bucket are left unlinked that a comparison of all pairs would have
linked, while a bucket of a few groups of copies costs some comparisons a row. Only a bucket of very many components
that are alike in a band costs more. Two texts at a similarity
of 0.75 share none of 32 bands of 4 rows with a probability of 5e-6; the least agreement
asked for is five standard deviations of a 128-place estimate below the threshold. Thresholds below 0.6 would need
more bands and are refused. Joins on keys that copies share are dealt out (spread_join), however many rows a key holds.

Null and empty texts, and texts of blanks, have no shingles: they are linked with
nothing and kept. A row without an id is linked with nothing, has a null component and
is kept. Rows that repeat an id are one node of the graph. An empty table gives an
empty result. Columns other than the id and the text are not read, so they cannot clash. A very long text is hashed
and compared by itself, in a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import superminhash as sm
from .common import discard, ship, spread_join, stored, thin, tidy
from .components import components
from .words import slices

PLACES, BANDS = 128, 32
LEFT_BLOCK, RIGHT_BLOCK = 512, 4096
LEVELS = 2
LEAST_SIMILARITY = 0.6
FILTER_BITS = 1 << 24


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in slices(texts):
            elements, offsets = sm.shingles(texts.slice(a, b - a), width)
            signature = sm.signatures(elements, offsets, PLACES)
            k1, k2 = sm.set_keys(elements, offsets)
            n = b - a
            bands = sm.band_keys(signature, BANDS).astype(np.int64, copy=False).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                ids.slice(a, n),
                pa.array(np.diff(offsets)),
                pa.array(k1.view(np.int64)),
                pa.array(k2.view(np.int64)),
                pa.array([row.tobytes() for row in sm.compact(signature)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1))),
            ], names=["id", "n_shingles", "k1", "k2", "sig", "bands"])


def signed_table(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return rows.mapInArrow(tidy(lambda b: _signed(b, width)), "id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, PLACES)


def _screened(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (a, b, sa, sb) whose signatures agree in `least` places."""
    for batch in batches:
        agree = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1)
        yield batch.select([0, 1]).filter(pa.array(agree >= least))


def _overlaps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(a, b, both, either) of rows (a, b, ta, tb): the sizes of the intersection and the union of their full sets."""
    held: dict[str, np.ndarray] = {}

    def sets(column: pa.Array) -> list[np.ndarray]:
        coded = column.dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = [t for t in names if t not in held]
        if new:
            elements, offsets = sm.shingles(pa.array(new, pa.string()), width)
            held.update((t, elements[offsets[i] : offsets[i + 1]]) for i, t in enumerate(new))
        own = [held[t] for t in names]
        return [own[i] for i in coded.indices.to_pylist()]

    for batch in thin(batches):
        if len(held) > 1000:
            held.clear()
        both, either = [], []
        for x, y in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
            both.append(_common(x, y) if len(x) and len(y) else 0)
            either.append(len(x) + len(y) - both[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"])


def _bands(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, BANDS)


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    elements, offsets = sm.shingles(texts, width)
    return [elements[offsets[i] : offsets[i + 1]] for i in range(len(texts))]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


class _Cell:
    """The left rows of one cell, and the (left row, component) pairs that are linked already."""

    def __init__(self) -> None:
        self.ids = self.comps = np.zeros(0, dtype=np.int64)
        self.sigs = np.zeros((0, PLACES), dtype=np.uint8)
        self.bands = np.zeros((0, BANDS), dtype=np.int64)
        self.sets: list[np.ndarray] = []
        self.linked: set[tuple[int, int]] = set()

    def add(self, ids, comps, sigs, bands, sets) -> None:
        self.ids, self.comps = np.concatenate([self.ids, ids]), np.concatenate([self.comps, comps])
        self.sigs, self.bands = np.vstack([self.sigs, sigs]), np.vstack([self.bands, bands])
        self.sets += sets

    def candidates(self, band: int, ids, comps, outside, sigs, bands, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(right, left) rows of other components to confirm here; two outside rows meet once."""
        found = []
        for lo in range(0, len(ids), 64):
            cut = slice(lo, lo + 64)
            open_ = self.comps[None, :] != comps[cut, None]
            open_ &= ~(outside[cut, None] & (self.ids[None, :] <= ids[cut, None]))
            right, left = np.nonzero(open_)
            for at in range(0, len(right), 8192):
                r, x = right[at : at + 8192] + lo, left[at : at + 8192]
                near = (self.sigs[x] == sigs[r]).sum(axis=1) >= least
                r, x = r[near], x[near]
                here = (self.bands[x] == bands[r]).argmax(axis=1) == band
                found.append((r[here], x[here]))
        return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2


def _across(batches: Iterator[pa.RecordBatch], width: int, least: int, part: int, whole: int) -> Iterator[pa.RecordBatch]:
    """Links between a cell's left rows and its right rows of other components.

    Rows (cell, band, role, id, comp, outside, sig, bands, text) arrive sorted by cell and
    role, left rows first. One link for each left row and component is enough.
    """
    cell, held = None, _Cell()
    for batch in thin(batches):
        cells, band, roles, ids, comps, outside = (np.asarray(batch.column(i)) for i in range(6))
        sigs, bands, texts = _matrix(batch.column(6)), _bands(batch.column(7)), batch.column(8)
        links: list[tuple[int, int]] = []
        edges = (np.flatnonzero(np.diff(cells)) + 1).tolist()
        for s, e in zip([0, *edges], [*edges, len(cells)], strict=True):
            if s == e:
                continue
            if cells[s] != cell:
                cell, held = cells[s], _Cell()
            cut = s + int(np.searchsorted(roles[s:e], 1))
            if cut > s:
                held.add(ids[s:cut], comps[s:cut], sigs[s:cut], bands[s:cut], _sets(texts.slice(s, cut - s), width))
            if cut == e or not len(held.ids):
                continue
            right, left = held.candidates(int(band[s]), ids[cut:e], comps[cut:e], outside[cut:e], sigs[cut:e], bands[cut:e], least)
            used, place = np.unique(right, return_inverse=True)
            own = _sets(texts.take(pa.array(used + cut)), width)
            for k, r, x in zip(place.tolist(), (right + cut).tolist(), left.tolist(), strict=True):
                if (x, comps[r]) in held.linked:
                    continue
                both = _common(held.sets[x], own[k])
                if both and whole * both >= part * (len(held.sets[x]) + len(own[k]) - both):
                    held.linked.add((x, comps[r]))
                    links.append((held.ids[x], ids[r]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (bkey, band, id, comp, left, right), dealt to the cells where each block of left rows meets each of right ones."""
    sizes = rows.groupBy("bkey").agg(F.count("*").alias("n"), F.count_if("left").alias("n_left"), F.count_if("right").alias("n_right"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    sizes = stored(sizes.filter("n_left > 0 and n_right > 0 and low < high"), "sizes")
    dealt = spread_join(rows, sizes.drop("n", "low", "high"), ["bkey"], sizes, rows.count())
    lefts, rights = F.ceil(F.col("n_left") / LEFT_BLOCK).cast("int"), F.ceil(F.col("n_right") / RIGHT_BLOCK).cast("int")
    spread, none = F.xxhash64("id"), F.array().cast("array<struct<l:int,r:int,role:int>>")
    own_left, own_right = F.pmod(spread, lefts).cast("int"), F.pmod(F.shiftright(spread, 20), rights).cast("int")
    as_left = F.when(F.col("left"), F.transform(F.sequence(F.lit(0), rights - 1), lambda r: F.struct(own_left.alias("l"), r.alias("r"), F.lit(0).alias("role")))).otherwise(none)
    as_right = F.when(F.col("right"), F.transform(F.sequence(F.lit(0), lefts - 1), lambda x: F.struct(x.alias("l"), own_right.alias("r"), F.lit(1).alias("role")))).otherwise(none)
    dealt = dealt.withColumn("x", F.explode(F.concat(as_left, as_right)))
    return dealt.select(F.xxhash64("bkey", "x.l", "x.r").alias("cell"), "band", F.col("x.role").alias("role"), "id", "comp", (F.col("left") & F.col("right")).alias("outside"))


def texts_of(docs: DataFrame, key: str, text: str, nodes: DataFrame) -> DataFrame:
    """(id, t) of a superset of the rows whose id is in nodes.

    A hashed bit table of FILTER_BITS, kept as 64-bit words, is broadcast: at most
    FILTER_BITS / 64 rows, whatever the number of nodes. It only spares the shuffle
    texts that no join wants; the join behind it decides.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    spot = {"word": F.shiftright(place, 6).cast("int"), "bit": place.bitwiseAND(F.lit(63)).cast("int")}
    words = nodes.select("id").withColumns(spot).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).withColumns(spot)
    return rows.join(F.broadcast(words), "word").filter(F.expr("bits & shiftleft(1L, bit) <> 0")).select("id", "t")


class _Run:
    """What the steps over one table share: its texts, signatures and thresholds."""

    def __init__(self, docs: DataFrame, key: str, text: str, width: int, part: int, whole: int):
        self.docs, self.key, self.text, self.width, self.part, self.whole = docs, key, text, width, part, whole
        self.least = int(PLACES * max(0.0, part / whole - 5 * (part / whole * (1 - part / whole) / PLACES) ** 0.5))
        self.linked = F.col("both") * whole >= F.col("either") * part
        self.several = False  # an id has several texts

    def screened(self, pairs: DataFrame, sigs: DataFrame) -> DataFrame:
        least = self.least
        full = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        return full.select("a", "b", "sa", "sb").mapInArrow(tidy(lambda x: _screened(x, least)), "a long, b long")

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """(a, b, both, either), stored."""
        width = self.width
        texts = texts_of(self.docs, self.key, self.text, pairs.select(F.col("a").alias("id")).union(pairs.select("b"))).hint("merge")
        full = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
        return stored(full.select("a", "b", "ta", "tb").mapInArrow(tidy(lambda x: _overlaps(x, width)), "a long, b long, both long, either long"), "overlaps")

    def across(self, cells: DataFrame, reps: DataFrame) -> DataFrame:
        """(a, b) links found in the cells, stored."""
        width, least, part, whole = self.width, self.least, self.part, self.whole
        texts = texts_of(self.docs, self.key, self.text, cells).hint("merge")
        full = cells.join(reps.select("id", "sig", "bands"), "id").join(texts, "id")
        full = full.select("cell", "band", "role", "id", "comp", "outside", "sig", "bands", F.col("t")).repartition("cell").sortWithinPartitions("cell", "role")
        return stored(full.mapInArrow(tidy(lambda x: _across(x, width, least, part, whole)), "a long, b long"), "links")

    def reach(self, rows: DataFrame, far: DataFrame) -> DataFrame:
        """Rows (bkey, band, id, comp, left, right) that may have a partner on the other side of the leader's component."""
        limit = 1 - self.part / self.whole + 1e-9
        gap = 1 - F.col("both") / F.col("either")
        gaps = far.groupBy(F.col("a").alias("id"), F.col("b").alias("lead")).agg(F.min(gap).alias("near"), F.max(gap).alias("far"))
        # A leader is at no distance from itself; where ids have several texts, they may lie anywhere.
        own = F.col("id") == F.col("lead")
        rows = rows.join(gaps, ["id", "lead"], "left").withColumns({"near": F.when(own, 0.0).otherwise(F.col("near")), "far": F.when(own, float(self.several)).otherwise(F.col("far"))})
        ends = rows.groupBy("bkey").agg(F.count("*").alias("n"), F.max(F.when(~F.col("out"), F.col("far"))).alias("inner"), F.min(F.when(F.col("out"), F.col("near"))).alias("outer"))
        ends = stored(ends.filter(F.col("outer") <= F.col("inner") + limit), "ends")
        kept = spread_join(stored(rows, "gaps"), ends.drop("n"), ["bkey"], ends, rows.count())
        kept = kept.filter(F.when(F.col("out"), F.col("near") <= F.col("inner") + limit).otherwise(F.col("far") >= F.col("outer") - limit))
        return kept.select("bkey", "band", "id", F.col("out").alias("left"), (~F.col("out")).alias("right"))


def _led(rows: DataFrame, total: int) -> DataFrame:
    """Rows (bkey, band, id, met) of buckets of two rows or more, with the bucket's leader; stored."""
    best = rows.groupBy("bkey").agg(F.count("*").alias("n"), F.max(F.struct("met", (-F.col("id")).alias("less"))).alias("x")).filter("n > 1")
    best = stored(best.select("bkey", "n", (-F.col("x.less")).alias("lead")), "leaders")
    return stored(spread_join(rows, best.drop("n"), ["bkey"], best, total), "led")


def _mixed(led: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with `out` for those outside the leader's; stored."""
    at = stored(led.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "at")
    kinds = at.groupBy("bkey").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.when(F.col("id") == F.col("lead"), F.col("comp"))).alias("lead_comp"))
    kinds = stored(kinds.filter("low < high"), "kinds")
    out = stored(spread_join(at, kinds.select("bkey", "lead_comp"), ["bkey"], kinds, at.count()).withColumn("out", F.expr("comp <> lead_comp")).drop("lead_comp"), "mixed")
    discard(at, kinds)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, part: int = 75, whole: int = 100) -> DataFrame:
    """One row per input row: key, n_shingles, component_id, kept.

    Two texts are linked if whole * |both| >= part * |either| for their sets of distinct
    `width`-word shingles; part / whole is at least LEAST_SIMILARITY.
    """
    if not LEAST_SIMILARITY * whole <= part <= whole:
        raise ValueError(f"part / whole must lie between {LEAST_SIMILARITY} and 1: {BANDS} bands miss links below")
    ship(docs.sparkSession)
    run = _Run(docs, key, text, width, part, whole)
    signed = stored(signed_table(docs, key, text, width), "signed")
    total = signed.count()
    classes = signed.filter("n_shingles > 0 and id is not null").groupBy("n_shingles", "k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    # Aggregates are written before they are joined back, with the sizes of their groups.
    classes = stored(classes, "classes")
    own = spread_join(signed, classes.drop("n"), ["n_shingles", "k1", "k2"], classes, total, "left")
    rep = F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))
    first = (F.col("id") == F.col("rep")) & (F.col("n_shingles") > 0)
    marked = stored(own.select("id", "n_shingles", rep.alias("rep"), F.when(first, F.col("sig")).alias("sig"), F.when(first, F.col("bands")).alias("bands")), "marked")
    by_rep = stored(classes.groupBy("rep").agg(F.sum("n").alias("n")), "by-rep")
    discard(signed, classes)
    reps = marked.filter("sig is not null")
    repeated = stored(marked.filter("id is not null").groupBy("id").count().filter("count > 1").select("id"), "repeated")
    if not repeated.isEmpty():
        run.several, reps = True, reps.dropDuplicates(["id", "sig"])

    banded = reps.select("id", F.posexplode("bands").alias("band", "bkey"))
    buckets = stored(banded.groupBy("bkey").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = stored(spread_join(banded, buckets.withColumn("size", F.col("n")).drop("n"), ["bkey"], buckets, total * BANDS), "shared")
    met = stored(shared.join(shared.groupBy("id").agg(F.sum("size").alias("met")), "id").select("bkey", "band", "id", "met"), "met")
    discard(shared, buckets)
    led = _led(met, met.count())
    discard(met)

    pairs = stored(run.screened(led.filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct(), reps.select("id", "sig")), "pairs")
    confirmed = run.overlaps(pairs)
    links = confirmed.filter(run.linked).select("a", "b").union(marked.filter("id <> rep").join(repeated, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    comp = components(links)
    discard(pairs, confirmed)

    def joined(more: DataFrame) -> DataFrame:
        """comp after further links: the components that these join are put together, as nodes of a graph of their own."""
        nodes = comp.select("node", F.col("component").alias("c"))
        ends = more.join(nodes.toDF("a", "ca"), "a", "left").join(nodes.toDF("b", "cb"), "b", "left")
        ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b")
        ends = stored(ends.distinct(), "joins")
        if ends.isEmpty():
            return comp
        whole = components(ends).select("node", F.col("component").alias("low"))
        old = comp.join(whole.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("low", "component").alias("component"))
        return stored(old.union(whole.join(comp.select("node"), "node", "left_anti").select("node", F.col("low").alias("component"))), "components")

    far, open_rows = None, []
    for level in range(LEVELS):
        mixed = _mixed(led, comp)
        discard(led)
        if mixed.isEmpty():
            led = mixed
            break
        if far is None:
            far = run.overlaps(mixed.filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct())
        open_rows.append(stored(run.reach(mixed, far).withColumn("bkey", F.xxhash64("bkey", F.lit(level))), "reach"))
        rest = mixed.filter("out").select("bkey", "band", "id", "met")
        led = _led(rest, rest.count())
        discard(mixed, far)
        far = run.overlaps(led.filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct())
        comp = joined(far.filter(run.linked).select("a", "b"))
    open_rows.append(led.select("bkey", "band", "id", F.lit(True).alias("left"), F.lit(True).alias("right")))
    at = reduce(DataFrame.unionByName, open_rows).join(comp.select(F.col("node").alias("id"), "component"), "id", "left")
    cells = stored(_blocks(stored(at.withColumn("comp", F.coalesce("component", "id")).drop("component"), "open")), "cells")
    if not cells.isEmpty():
        comp = joined(run.across(cells, reps))
    discard(cells, led)

    grouped = spread_join(marked, comp.select(F.col("node").alias("rep"), "component"), ["rep"], by_rep, total, "left")
    out = grouped.select(F.col("id").alias(key), "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
