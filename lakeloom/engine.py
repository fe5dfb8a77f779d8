"""From a query's text to a lazy DataFrame."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import compile_expr, compile_filter
from .mapping import Config, Mapping, TriplesMap, load_config, load_mapping
from .operators import graph, tabular
from .operators.modifiers import apply_modifiers
from .operators.scan import IRI, RAW, scan_star, scope_of
from .plans import PlanError, plan_group
from .plans.stars import GroupPlan, conjuncts, group_variables, wanted_variables
from .selector import DEFAULT_SELECTOR, Selector, plan_features
from .sources import SourceRegistry, default_registry
from .sparql import ast, parse_query
from .sparql.ast import Group, Literal, variables

MODELS = ("tabular", "graph", "auto")


@dataclass
class QueryResult:
    """The result, what the plan looks like, and seconds by phase."""

    df: DataFrame
    model: str
    info: dict[str, float] = field(default_factory=dict)
    timings: dict[str, float] = field(default_factory=dict)

    def run(self) -> list:
        """Execute; adds the result count and the execution time."""
        began = time.perf_counter()
        rows = self.df.collect()
        self.timings["execution"] = time.perf_counter() - began
        self.info["rows"] = len(rows)
        return rows

    def count(self) -> int:
        began = time.perf_counter()
        n = self.df.count()
        self.timings["execution"] = time.perf_counter() - began
        self.info["rows"] = n
        return n

    def memory(self) -> dict[str, float]:
        """Storage memory in use on the driver's and the executors' block managers, in MB, and the parallelism."""
        status = self.df.sparkSession.sparkContext._jsc.sc().getExecutorMemoryStatus()
        used, it = 0.0, status.valuesIterator()
        while it.hasNext():
            pair = it.next()
            used += (pair._1() - pair._2()) / 1e6
        return {"storage_mb": used, "parallelism": self.df.sparkSession.sparkContext.defaultParallelism}


class Engine:
    """Queries over the sources of a mapping.

    strict: a triple pattern over a null attribute gives no row (else the variable is null).
    iri: subjects are IRIs by their template (else the source's keys).
    by_weight: the join order follows source weights and filters (else the pattern's order).
    """

    def __init__(self, spark: SparkSession, mapping: str | Mapping, config: str | Config = Config(), registry: SourceRegistry | None = None, strict: bool = True, iri: bool = False, by_weight: bool = True, cross_joins: bool = False, selector: Selector = DEFAULT_SELECTOR):
        self.spark = spark
        self.mapping = load_mapping(mapping) if isinstance(mapping, str) else mapping
        self.config = load_config(config) if isinstance(config, str) else config
        self.registry = registry or default_registry()
        self.strict, self.iri, self.by_weight, self.cross_joins, self.selector = strict, iri, by_weight, cross_joins, selector
        self._loaded: dict[tuple[str, str], DataFrame] = {}

    def load(self, m: TriplesMap) -> DataFrame:
        key = m.store, m.source
        if key not in self._loaded:
            self._loaded[key] = self.registry.read(self.spark, m.store, m.source, self.config.options_of(m.source))
        return self._loaded[key]

    def query(self, text: str, model: str = "tabular") -> QueryResult:
        if model not in MODELS:
            raise ValueError(f"model is one of {', '.join(MODELS)}")
        began = time.perf_counter()
        q = parse_query(text)
        wanted = wanted_variables(q)
        plan = self._plan(q.where, wanted, q.transforms)
        info = plan_features(q, plan)
        if model == "auto":
            model = self.selector.choose(info)
        analysed = time.perf_counter()
        found = self._bindings(plan, model, wanted)
        found = self._shown(found)
        df = apply_modifiers(found, q)
        return QueryResult(df, model, info, {"analysis": analysed - began, "sources": time.perf_counter() - analysed})

    def graph(self, text: str) -> graph.PropertyGraph:
        """The vertices and edges that a query's pattern touches."""
        q = parse_query(text)
        plan = self._plan(q.where, wanted_variables(q), q.transforms)
        return graph.property_graph(plan, self._tables(plan))

    def _plan(self, g: Group, wanted: set[str], transforms: tuple[ast.JoinTransform, ...] = ()) -> GroupPlan:
        return plan_group(g, self.mapping, self.config, wanted, transforms, self.by_weight, self.cross_joins)

    def _tables(self, plan: GroupPlan) -> dict[str, DataFrame]:
        return {p.star.name: scan_star(p, self.load, self.strict, self.iri, plan.transforms) for p in plan.stars}

    def _bindings(self, plan: GroupPlan, model: str, wanted: set[str]) -> DataFrame:
        """One row for each solution of a group."""
        g, parts = plan.group, []
        if plan.stars:
            tables = self._tables(plan)
            parts.append(graph.match_motif(plan, tables) if model == "graph" else tabular.join_stars(plan, tables))
        parts += [self._values(v) for v in g.values]
        for union in g.unions:
            sides = [self._inner(side, model, wanted | self._shared(g)) for side in union]
            parts.append(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides))
        if not parts:
            raise PlanError("a group needs a pattern")
        for a, b in zip(parts, parts[1:], strict=False):
            if not self.cross_joins and not set(tabular.pattern_columns(a)) & set(tabular.pattern_columns(b)):
                raise PlanError("two parts of the pattern share no variable")
        out = reduce(tabular.natural_join, parts)
        for inner in g.optionals:
            out = self._optional(out, inner, model, wanted | self._shared(g))
        for e, v in g.binds:
            out = out.withColumn(v.name, compile_expr(e, scope_of(out))[0])
        for inner in g.minus:
            other = self._inner(inner, model, set(tabular.pattern_columns(out)))
            if set(tabular.pattern_columns(out)) & set(tabular.pattern_columns(other)):
                out = tabular.natural_join(out, other, "left_anti")
        scope = scope_of(out)
        for f in plan.filters:
            out = out.filter(compile_filter(f, scope))
        return out

    @staticmethod
    def _shared(g: Group) -> set[str]:
        return group_variables(g) | set().union(*(variables(f) for f in g.filters))

    def _inner(self, g: Group, model: str, wanted: set[str]) -> DataFrame:
        return self._bindings(self._plan(g, wanted & group_variables(g)), model, wanted)

    def _optional(self, left: DataFrame, g: Group, model: str, wanted: set[str]) -> DataFrame:
        """A left join; a filter of the optional part that reads outer variables is a condition of the join."""
        own = group_variables(g)
        parts = [c for f in g.filters for c in conjuncts(f)]
        inner = Group(g.triples, tuple(f for f in parts if variables(f) <= own), g.optionals, g.unions, g.minus, g.binds, g.values)
        outer = [f for f in parts if not variables(f) <= own]
        right = self._inner(inner, model, wanted | set().union(*map(variables, outer)))

        def extra(a: DataFrame, b: DataFrame):
            scope = {**{f.name.removeprefix("__r_"): (b[f"`{f.name}`"], f.dataType) for f in b.schema.fields}, **{f.name: (a[f"`{f.name}`"], f.dataType) for f in a.schema.fields}}
            return reduce(lambda x, y: x & y, (compile_filter(f, scope) for f in outer))

        return tabular.natural_join(left, right, "left", extra if outer else None)

    def _values(self, v: ast.Values) -> DataFrame:
        def plain(x):
            if x is None:
                return None
            if isinstance(x, Literal) and x.is_number:
                return float(x.lex) if any(c in x.lex for c in ".eE") else int(x.lex)
            return x.lex if isinstance(x, Literal) else x.value

        columns = list(zip(*[[plain(x) for x in row] for row in v.rows], strict=True)) or [()] * len(v.variables)
        kinds = ["string" if any(isinstance(x, str) for x in c) or not c else "double" if any(isinstance(x, float) for x in c) else "bigint" for c in columns]
        rows = [tuple(None if x is None else str(x) if k == "string" else float(x) if k == "double" else x for x, k in zip(r, kinds, strict=True)) for r in zip(*columns, strict=True)]
        return self.spark.createDataFrame(rows, ", ".join(f"`{n.name}` {k}" for n, k in zip(v.variables, kinds, strict=True)))

    @staticmethod
    def _shown(df: DataFrame) -> DataFrame:
        """Subjects as results show them: the untransformed key, or the IRI."""
        raw = {c.removeprefix(RAW): c for c in df.columns if c.startswith(RAW)} | {c.removeprefix(IRI): c for c in df.columns if c.startswith(IRI)}
        for name, column in raw.items():
            df = df.withColumn(name, F.col(f"`{column}`"))
        return df.drop(*[c for c in df.columns if c.startswith((RAW, IRI))])
