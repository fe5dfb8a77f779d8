"""The tabular model: stars are relations, patterns are joined on the variables they share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stars import GroupPlan, StarPlan
from .scan import key_column


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner", extra=None) -> DataFrame:
    """Join on all shared variables; `extra` gives a further condition from the joined columns."""
    shared = [c for c in left.columns if c in right.columns and not c.startswith("__")]
    inner = right.withColumnsRenamed({c: f"__r_{c}" for c in shared})
    for c in [c for c in inner.columns if c.startswith("__") and not c.startswith("__r_") and c in left.columns]:
        inner = inner.drop(c)
    conditions: list[Column] = [key_column(left, c, inner.schema[f"__r_{c}"].dataType) == key_column(inner, f"__r_{c}", left.schema[c].dataType) for c in shared]
    if extra is not None:
        conditions.append(extra(left, inner))
    joined = left.join(inner, reduce(lambda a, b: a & b, conditions), how) if conditions else left.crossJoin(inner)
    return joined.drop(*[f"__r_{c}" for c in shared]) if how not in ("left_semi", "left_anti") else joined


def join_stars(plan: GroupPlan, tables: dict[str, DataFrame]) -> DataFrame:
    """Left-deep, in the plan's order. Cycles close by themselves: all shared variables are compared."""

    def step(done: DataFrame, p: StarPlan) -> DataFrame:
        table = tables[p.star.name]
        # The key's own value and IRI come with the star that it identifies.
        return natural_join(done, table)

    first, *rest = plan.stars
    out = reduce(step, rest, tables[first.star.name])
    return out.drop("__one") if "__one" in out.columns and len(out.columns) > 1 else out


def pattern_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


def one_row(df_like: DataFrame) -> DataFrame:
    return df_like.sparkSession.range(1).select(F.lit(1).alias("__one"))
