"""Quality rules: text statistics, a fixed base rule and a learned decision list.

Everything is DataFrame expressions. The list is learned by sequential covering:
a conjunction of thresholds is grown by information gain on two thirds of the
labelled rows, pruned on the other third, kept if it is precise there, and the
rows it covers are set aside before the next one. Each step is one aggregation of
labelled rows to counts per (feature, bin, label), and one to the two values next to the
threshold taken, which is moved halfway between them. That is all that reaches the driver;
its size depends on the number of features and thresholds only. The rules become one
ordered CASE expression.

Null and empty texts have no words: all counts are 0 and the base rule fails them.
Null ids and repeated rows are judged like any others, since a verdict depends on
the text alone. Labels that are null or belong to no document teach nothing; with
no usable labels the list is empty and the base rule alone decides. An empty table
gives an empty result; input columns that clash with result columns are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbols_per_word", "capital_share", "bangs_per_word", "digit_share", "dup_line_share", "repeat_share", "distinct_share", "mean_word", "long_words", "stop_marks")


def _amount(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def _covered(hashes: Column) -> Column:
    """Words in 3-word windows that occur at least twice; hashes: one per window, in order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
        return F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))

    def span(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.coalesce(F.least(F.lit(3), F.get(at, j + 1) - p), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(pairs, lambda s: let(F.sort_array(F.transform(repeated(s), lambda x: x["i"])), span))


def repeat_words(words: Column) -> Column:
    """words must be a lambda variable or a plain column."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some)


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts of COUNTS (long), the ratios of SHARES and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    of_words = let(words_of(t), lambda w: F.struct(
        F.size(w).alias("n_words"),
        F.size(F.array_distinct(w)).alias("n_distinct"),
        F.size(F.filter(w, lambda x: F.length(x) > 16)).alias("n_long"),
        repeat_words(w).alias("n_repeat_words"),
    ))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    out = df.withColumns({"_w": of_words, "_l": of_lines, "_chars": F.length(F.translate(t, BLANKS, ""))})
    words, chars = F.greatest(F.col("_w.n_words"), F.lit(1)), F.greatest(F.col("_chars"), F.lit(1))
    out = out.withColumns({
        "n_words": F.col("_w.n_words").cast("long"),
        "word_chars": F.col("_chars").cast("long"),
        "n_symbols": _amount(t, SYMBOLS).cast("long"),
        "n_dup_lines": (F.col("_l.n") - F.col("_l.d")).cast("long"),
        "n_repeat_words": F.col("_w.n_repeat_words").cast("long"),
        "symbols_per_word": _amount(t, SYMBOLS) / words,
        "capital_share": _amount(t, CAPITALS) / chars,
        "bangs_per_word": _amount(t, "!?") / words,
        "digit_share": _amount(t, "0123456789") / chars,
        "dup_line_share": (F.col("_l.n") - F.col("_l.d")) / F.greatest(F.col("_l.n"), F.lit(1)),
        "repeat_share": F.col("_w.n_repeat_words") / words,
        "distinct_share": F.col("_w.n_distinct") / words,
        "mean_word": F.col("_chars") / words,
        "long_words": F.col("_w.n_long") / words,
        "stop_marks": _amount(t, ".,;:") / words,
    }).drop("_w", "_l", "_chars")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds names the reason for a rejection."""

    rules: tuple[Rule, ...] = ()

    def reason(self) -> Column:
        none = F.lit(None).cast("string")
        return reduce(lambda out, r: F.when(r.column(), F.lit(str(r))).otherwise(out), reversed(self.rules), none)


def _no(p: float, n: float) -> float:
    """Bits that tell a covered row to be of the target class."""
    return -math.log2((p + 1) / (p + n + 2))


def _cuts(rows: DataFrame, features: Sequence[str], n_cuts: int) -> dict[str, list[float]]:
    """Thresholds of each feature: quantiles of either class."""
    at = F.array(*[F.lit((i + 1) / (n_cuts + 1)) for i in range(n_cuts)])
    found = rows.groupBy("_bad").agg(*[F.percentile_approx(f, at, 2000).alias(f) for f in features]).collect()
    return {f: sorted({float(x) for row in found for x in row[f] or []}) for f in features}


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """Rows by feature and bin (thresholds below the value): [of the target class, others]."""
    used = [f for f in cuts if cuts[f]]

    def below(f: str) -> Column:
        return F.size(F.filter(F.lit(cuts[f]), lambda t: t < F.col(f)))

    bins = [F.struct(F.lit(f).alias("f"), below(f).alias("b")) for f in used]
    cells = rows.select("_bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.b", "_bad").count().collect()
    out = {f: [[0, 0] for _ in range(len(cuts[f]) + 1)] for f in used}
    for c in cells:
        out[c["f"]][c["b"]][0 if c["_bad"] else 1] += c["count"]
    return out


def _best(cells: dict[str, list[list[int]]], cuts: dict[str, list[float]], p0: int, n0: int, least: int) -> tuple[float, Condition | None, int, int]:
    top: tuple[float, Condition | None, int, int] = (1e-9, None, 0, 0)
    for f in sorted(cells):
        p = n = 0
        for b, t in enumerate(cuts[f]):
            p, n = p + cells[f][b][0], n + cells[f][b][1]
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                if pp >= least and (gain := pp * (_no(p0, n0) - _no(pp, nn))) > top[0]:
                    top = (gain, Condition(f, above, t), pp, nn)
    return top


def _centred(rows: DataFrame, c: Condition) -> Condition:
    """c with its threshold halfway between the nearest values on either side, which splits rows alike."""
    x = F.col(c.feature)
    low, high = rows.agg(F.max(F.when(x <= c.threshold, x)), F.min(F.when(x > c.threshold, x))).first()
    return c if low is None or high is None else Condition(c.feature, c.above, (float(low) + float(high)) / 2)


def learn_list(rows: DataFrame, features: Sequence[str] = (*SHARES, "n_words"), target: str = "_bad", max_rules: int = 8, max_conditions: int = 4, n_cuts: int = 24, min_precision: float = 0.9, min_share: float = 0.01) -> DecisionList:
    """Sequential covering over labelled rows with a boolean `_bad` and a boolean `_grow`.

    A rule is accepted if at least min_precision of the rows of the pruning third that
    it covers are bad, and it covers at least min_share of the bad rows there. Only
    counts and at most 2 * n_cuts thresholds a feature come to the driver.
    """
    rows = rows.withColumnRenamed(target, "_bad") if target != "_bad" else rows
    cuts = _cuts(rows.filter("_grow"), features, n_cuts)
    total = rows.filter("not _grow and _bad").count()
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules and total:
        held, conditions = left.filter("_grow"), []
        cells = _counts(held, cuts)
        if not cells:
            break
        any_f = next(iter(cells.values()))
        p, n = sum(c[0] for c in any_f), sum(c[1] for c in any_f)
        while len(conditions) < max_conditions and p and n:
            _, best, pp, nn = _best(cells, cuts, p, n, max(3, int(min_share * p)))
            if best is None:
                break
            best = _centred(held, best)
            conditions.append(best)
            held, p, n = held.filter(best.column()), pp, nn
            cells = _counts(held, cuts)
        if not conditions:
            break
        prefix = [reduce(lambda a, b: a & b, (c.column() for c in conditions[: k + 1])) for k in range(len(conditions))]
        seen = left.filter("not _grow").agg(*[F.count_if(c & F.col("_bad")).alias(f"p{k}") for k, c in enumerate(prefix)], *[F.count_if(c & ~F.col("_bad")).alias(f"n{k}") for k, c in enumerate(prefix)]).first()
        worth = [((seen[f"p{k}"] - seen[f"n{k}"]) / max(1, seen[f"p{k}"] + seen[f"n{k}"]), -k) for k in range(len(prefix))]
        k = -max(worth)[1]
        good, bad = seen[f"p{k}"], seen[f"n{k}"]
        if good < max(1, min_share * total) or good < min_precision * (good + bad):
            break
        rules.append(Rule(tuple(conditions[: k + 1]), good / (good + bad)))
        left = left.filter(~rules[-1].column())
    return DecisionList(tuple(rules))


def labelled(statistics: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Rows of known quality that pass the base rule, two thirds of them for growing."""
    known = labels.select(F.col(key).alias("_key"), (F.col(label) == 0).alias("_bad")).filter("_bad is not null and _key is not null")
    rows = statistics.filter("not base_failed").join(known, F.col(key) == F.col("_key"))
    return rows.select(*SHARES, "n_words", "_bad", (F.pmod(F.xxhash64("_key"), F.lit(3)) > 0).alias("_grow"))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", **options) -> DecisionList:
    """Statistics of all documents, written to the shared folder without the texts, then the list."""
    statistics = stored(text_statistics(documents.select(key, text), text).drop(text), "quality")
    return learn_list(stored(labelled(statistics, labels, key, label), "quality-fit"), **options)


def judge(statistics: DataFrame, rules: DecisionList) -> DataFrame:
    """Statistics with `reason` (the rule that rejects, or base) and `kept`."""
    reason = F.when(F.col("base_failed"), F.lit("base")).otherwise(rules.reason())
    return statistics.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())
