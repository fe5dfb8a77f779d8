"""A star over its sources: one row for each binding of its variables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import apply_calls, compile_filter
from ..functions.expressions import compile_expr
from ..mapping import TriplesMap
from ..mapping.rml import SPARK_TYPES, Attribute
from ..plans.stars import StarPlan
from ..sparql.ast import JoinTransform, Op, Var, variables

RAW, IRI = "__raw_", "__iri_"
Load = Callable[[TriplesMap], DataFrame]


def scope_of(df: DataFrame) -> dict:
    """Columns that expressions may name; a subject is seen as its raw key."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return {n: (F.col(f"`{RAW}{n}`"), types[RAW + n]) if RAW + n in types else (F.col(f"`{n}`"), t) for n, t in types.items() if not n.startswith("__")}


def _attribute(df: DataFrame, a: Attribute, name: str) -> DataFrame:
    df = apply_calls(df.withColumn(name, F.col(f"`{a.name}`")), name, a.calls)
    kind = SPARK_TYPES.get(a.datatype or "")
    return df.withColumn(name, F.col(f"`{name}`").try_cast(kind)) if kind and kind != dict(df.dtypes)[name] else df


def _subject_iri(template: str, key: str):
    head, _, tail = template.rpartition("{" + key + "}")
    return F.concat(F.lit(head), F.col("__key").cast("string"), F.lit(tail))


def _from_source(plan: StarPlan, m: TriplesMap, df: DataFrame, strict: bool, iri: bool) -> DataFrame:
    star = plan.star
    df = _attribute(df, m.subject, "__key")
    names: dict[str, list[str]] = {}
    equal = []
    for i, (predicate, obj) in enumerate(star.patterns):
        column = f"__p{i}"
        df = _attribute(df, m.predicates[predicate], column)
        if isinstance(obj, Var):
            names.setdefault(obj.name, []).append(column)
        else:
            equal.append((column, obj))
    types = {f.name: f.dataType for f in df.schema.fields}
    scope = {c: (F.col(f"`{c}`"), types[c]) for c in types if c.startswith("__")}
    for column, obj in equal:
        df = df.filter(compile_expr(Op("=", (Var(column), obj)), scope)[0])
    if isinstance(star.subject, Var):
        names.setdefault(star.subject.name, []).insert(0, "__key")
    else:
        pattern = re.escape(m.template).replace(re.escape("{" + m.subject.name + "}"), "(.*)")
        found = re.fullmatch(pattern, star.subject.value)
        df = df.filter(F.col("__key").cast("string") == (found[1] if found else star.subject.value))
    for columns in names.values():
        for other in columns[1:]:  # one variable twice in the star
            df = df.filter(compile_expr(Op("=", (Var(columns[0]), Var(other))), scope)[0])
    if strict:
        needed = ["__key", *(f"__p{i}" for i in range(len(star.patterns)))]
        df = df.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in needed)))
    kept = {n for n in names if n in plan.needed or any(n in variables(f) for f in plan.filters)}
    out = [F.col(c[0]).alias(n) for n, c in names.items() if n in kept]
    if iri and isinstance(star.subject, Var) and star.subject.name in kept:
        out.append(_subject_iri(m.template, m.subject.name).alias(IRI + star.subject.name))
    return df.select(*out) if out else df.select(F.lit(1).alias("__one"))


def _union(parts: list[DataFrame]) -> DataFrame:
    """By name; columns whose types differ between sources become text."""
    kinds = [dict(p.dtypes) for p in parts]
    mixed = {n for n in kinds[0] if len({k[n] for k in kinds}) > 1}
    cast = [p.withColumns({n: F.col(f"`{n}`").cast("string") for n in mixed}) if mixed else p for p in parts]
    return reduce(DataFrame.unionByName, cast)


def scan_star(plan: StarPlan, load: Load, strict: bool = True, iri: bool = False, transforms: tuple[JoinTransform, ...] = ()) -> DataFrame:
    """One column for each needed variable of the star.

    A transformation of the star's key leaves the key as it was in a second column, which is
    what filters and results see; one of a foreign key replaces it.
    """
    star, parts = plan.star, []
    for m in plan.maps:
        part = _from_source(plan, m, load(m), strict, iri)
        for t in transforms:
            if t.side == "l" and t.left.name == star.name and t.right.name in part.columns:
                part = apply_calls(part, t.right.name, t.calls)
            if t.side == "r" and t.right.name == star.name and star.name in part.columns:
                part = apply_calls(part.withColumn(RAW + star.name, F.col(f"`{star.name}`")), star.name, t.calls)
        parts.append(part)
    out = _union(parts)
    scope = scope_of(out)
    for f in plan.filters:
        out = out.filter(compile_filter(f, scope))
    extra = [c for c in out.columns if c not in plan.needed and not c.startswith("__")]
    return out.drop(*extra) if len(extra) < len(out.columns) else out.select(F.lit(1).alias("__one"))


def key_column(df: DataFrame, name: str, other: T.DataType):
    """A join key in a type that both sides share."""
    own = df.schema[name].dataType
    c = df[f"`{name}`"]
    if own == other or isinstance(own, T.NumericType) and isinstance(other, T.NumericType):
        return c
    if {type(own), type(other)} & {T.DoubleType, T.FloatType, T.DecimalType}:
        return c.try_cast("double")
    return c.cast("string")
