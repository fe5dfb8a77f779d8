"""Solution modifiers, in the order: group, having, project, distinct, order, offset, limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compile_expr, compile_filter
from ..sparql import ast
from ..sparql.ast import Aggregate, Expr, Op, Var
from ..sparql.parser import QueryError
from .scan import scope_of


def _aggregates(e: Expr) -> list[Aggregate]:
    if isinstance(e, Aggregate):
        return [e]
    return [a for x in e.args for a in _aggregates(x)] if isinstance(e, Op) else []


def _compile(a: Aggregate, scope: dict) -> Column:
    if a.arg is None:
        return F.count_distinct(*[c for c, _ in scope.values()]) if a.distinct else F.count(F.lit(1))
    c, kind = compile_expr(a.arg, scope)
    if a.fn == "COUNT":
        return F.count_distinct(c) if a.distinct else F.count(c)
    if a.fn in ("SUM", "AVG"):
        c = c if isinstance(kind, T.NumericType) else c.try_cast("double")
        if a.distinct:
            return F.sum_distinct(c) if a.fn == "SUM" else F.try_divide(F.sum_distinct(c.cast("double")), F.count_distinct(c).cast("double"))
        return F.sum(c) if a.fn == "SUM" else F.avg(c)
    if a.fn in ("MIN", "MAX", "SAMPLE"):
        return {"MIN": F.min, "MAX": F.max, "SAMPLE": F.min}[a.fn](c)
    values = F.collect_set(c.cast("string")) if a.distinct else F.collect_list(c.cast("string"))
    return F.array_join(F.array_sort(values), a.separator)


def _without_aggregates(e: Expr, names: dict[Aggregate, str]) -> Expr:
    if isinstance(e, Aggregate):
        return Var(names[e])
    return Op(e.name, tuple(_without_aggregates(x, names) for x in e.args)) if isinstance(e, Op) else e


def apply_modifiers(df: DataFrame, q: ast.Query) -> DataFrame:
    select = list(q.select) or [(Var(c), c) for c in df.columns if not c.startswith("__")]
    orders = list(q.order_by)
    exprs = [*(e for e, _ in select), *q.having, *(e for e, _ in orders)]
    used = list(dict.fromkeys(a for e in exprs for a in _aggregates(e)))
    if q.group_by or used:
        scope = scope_of(df)
        keys = [compile_expr(e, scope)[0].alias(n) for e, n in q.group_by]
        names = {a: f"agg_{i}_" for i, a in enumerate(used)}
        measures = [_compile(a, scope).alias(n) for a, n in names.items()]
        grouped = df.groupBy(*keys)
        df = grouped.agg(*measures) if measures else df.select(*keys).distinct()
        known = {n for _, n in q.group_by}
        select = [(_without_aggregates(e, names), n) for e, n in select]
        loose = set().union(*(ast.variables(e) for e, _ in select)) - known - set(names.values())
        if loose:
            raise QueryError(f"{', '.join('?' + v for v in sorted(loose))} must be grouped by or aggregated")
        orders = [(_without_aggregates(e, names), asc) for e, asc in orders]
        for h in q.having:
            df = df.filter(compile_filter(_without_aggregates(h, names), scope_of(df)))
    scope = scope_of(df)
    out = [compile_expr(e, scope)[0].alias(n) for e, n in select]
    selected = {n: e for e, n in select}
    keys, hidden = [], []
    for i, (e, asc) in enumerate(orders):
        if isinstance(e, Var) and e.name in selected:
            name = e.name
        else:
            same = next((n for n, x in selected.items() if x == e), None)
            if same is None and q.distinct:
                raise QueryError("with DISTINCT, order keys must be selected")
            name = same or f"__o{i}"
            if same is None:
                hidden.append(compile_expr(e, {**scope, **{n: compile_expr(x, scope) for n, x in selected.items() if n not in scope}})[0].alias(name))
        keys.append(F.col(f"`{name}`").asc() if asc else F.col(f"`{name}`").desc())
    df = df.select(*out, *hidden)
    if q.distinct:
        df = df.distinct()
    if keys:
        df = df.orderBy(*keys)
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return df.drop(*[f"__o{i}" for i in range(len(orders))]) if hidden else df
