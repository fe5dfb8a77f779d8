"""Triples to stars, stars to sources, and the order in which stars are joined."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from ..mapping import Config, Mapping, TriplesMap
from ..sparql import ast
from ..sparql.ast import Expr, Group, Iri, JoinTransform, Literal, Var, variables


class PlanError(ValueError):
    """The pattern cannot be planned over this mapping."""


class NoSourceError(PlanError):
    pass


@dataclass(frozen=True)
class Star:
    """All triple patterns of one subject."""

    subject: Var | Iri
    patterns: tuple[tuple[str, Var | Iri | Literal], ...]
    classes: frozenset[str]

    @property
    def name(self) -> str:
        return self.subject.name if isinstance(self.subject, Var) else local(self.subject.value)

    @property
    def predicates(self) -> set[str]:
        return {p for p, _ in self.patterns}

    @property
    def variables(self) -> set[str]:
        own = {self.subject.name} if isinstance(self.subject, Var) else set()
        return own | {o.name for _, o in self.patterns if isinstance(o, Var)}


def local(iri: str) -> str:
    return iri.replace("#", "/").rstrip("/").rsplit("/", 1)[-1]


def stars_of(triples: tuple[ast.Triple, ...]) -> list[Star]:
    """Stars in order of appearance; equal patterns count once."""
    found: dict[object, tuple[list, set]] = {}
    for t in triples:
        if isinstance(t.subject, Literal):
            raise PlanError("a literal cannot be a subject")
        patterns, classes = found.setdefault(t.subject, ([], set()))
        if t.predicate.value == ast.RDF_TYPE:
            if not isinstance(t.object, Iri):
                raise PlanError("rdf:type needs a class")
            classes.add(t.object.value)
        elif (t.predicate.value, t.object) not in patterns:
            patterns.append((t.predicate.value, t.object))
    return [Star(s, tuple(p), frozenset(c)) for s, (p, c) in found.items()]


@dataclass(frozen=True)
class JoinEdge:
    """left's object under `predicate` is right's subject, or (predicate None) both hold `variable`."""

    left: str
    right: str
    variable: str
    predicate: str | None = None


def join_edges(stars: list[Star]) -> list[JoinEdge]:
    by_subject = {s.subject.name: s for s in stars if isinstance(s.subject, Var)}
    edges = [JoinEdge(s.name, o.name, o.name, p) for s in stars for p, o in s.patterns if isinstance(o, Var) and o.name in by_subject and o.name != s.name]
    holders: dict[str, list[str]] = {}
    for s in stars:
        for _, o in s.patterns:
            if isinstance(o, Var) and o.name not in by_subject and s.name not in holders.setdefault(o.name, []):
                holders[o.name].append(s.name)
    return edges + [JoinEdge(names[0], other, v) for v, names in holders.items() for other in names[1:]]


@dataclass(frozen=True)
class StarPlan:
    """A star with its sources, the variables wanted from it, and the filters over it alone."""

    star: Star
    maps: tuple[TriplesMap, ...]
    needed: frozenset[str]
    filters: tuple[Expr, ...] = ()
    weight: float = 0.0


@dataclass(frozen=True)
class GroupPlan:
    stars: tuple[StarPlan, ...]  # in join order
    edges: tuple[JoinEdge, ...]
    filters: tuple[Expr, ...]  # over several stars, or over what is joined later
    group: Group
    transforms: tuple[JoinTransform, ...] = field(default=())

    def edge_between(self, done: set[str], name: str) -> list[JoinEdge]:
        return [e for e in self.edges if {e.left, e.right} <= done | {name} and name in (e.left, e.right)]


def conjuncts(e: Expr) -> list[Expr]:
    return [c for a in e.args for c in conjuncts(a)] if isinstance(e, ast.Op) and e.name == "&&" else [e]


def group_variables(g: Group) -> set[str]:
    out = {x.name for t in g.triples for x in (t.subject, t.object) if isinstance(x, Var)}
    out |= {v.name for _, v in g.binds} | {v.name for b in g.values for v in b.variables}
    for inner in (*g.optionals, *(x for u in g.unions for x in u)):
        out |= group_variables(inner)
    return out


def mentioned(g: Group) -> set[str]:
    """All variables that a group's parts other than its own triples mention."""
    out = set().union(*(variables(f) for f in g.filters), *(variables(e) for e, _ in g.binds), {v.name for _, v in g.binds}, {v.name for b in g.values for v in b.variables})
    for inner in (*g.optionals, *g.minus, *(x for u in g.unions for x in u)):
        out |= group_variables(inner) | mentioned(inner)
    return out


def wanted_variables(q: ast.Query) -> set[str]:
    """Variables that anything behind the pattern reads."""
    exprs = [*(e for e, _ in q.select), *(e for e, _ in q.group_by), *q.having, *(e for e, _ in q.order_by)]
    if q.select_all or any(isinstance(e, ast.Aggregate) and e.arg is None and e.distinct for e in exprs):
        return group_variables(q.where)
    return set().union(*map(variables, exprs)) if exprs else set()


def order_stars(plans: list[StarPlan], edges: list[JoinEdge], by_weight: bool) -> list[StarPlan]:
    """Start with the best-scored join, then the best-scored star that is linked to what is joined."""
    if len(plans) < 2:
        return plans
    left, score = {p.star.name: p for p in plans}, {p.star.name: p.weight for p in plans}
    if by_weight and edges:
        first = max(edges, key=lambda e: score[e.left] + score[e.right])
        start = max((first.left, first.right), key=lambda n: score[n])
    else:
        start = plans[0].star.name
    out = [left.pop(start)]
    while left:
        done = {p.star.name for p in out}
        linked = [n for n in left if any({e.left, e.right} <= done | {n} and n in (e.left, e.right) for e in edges)]
        if not linked:
            raise PlanError(f"the pattern falls apart: {', '.join(sorted(left))} shares no variable with {', '.join(sorted(done))}")
        out.append(left.pop(max(linked, key=lambda n: score[n]) if by_weight else linked[0]))
    return out


def plan_group(g: Group, mapping: Mapping, config: Config, wanted: set[str], transforms: tuple[JoinTransform, ...] = (), by_weight: bool = True, cross_joins: bool = False) -> GroupPlan:
    stars = stars_of(g.triples)
    edges = join_edges(stars)
    uses = Counter(v for s in stars for v in s.variables)
    outside = wanted | mentioned(g) | {v for v, n in uses.items() if n > 1}
    own = {s.name: s.variables for s in stars}
    filters = [c for f in g.filters for c in conjuncts(f)]
    late = {v for inner in g.optionals for v in group_variables(inner)} | {v.name for _, v in g.binds}
    early = {s.name: [f for f in filters if variables(f) and variables(f) <= own[s.name] - late] for s in stars}
    plans = []
    for s in stars:
        maps = mapping.candidates(s.predicates, set(s.classes))
        if not maps:
            raise NoSourceError(f"no source answers ?{s.name} with all of {sorted(map(local, s.predicates))}")
        weights = {config.weight_of(m.store) for m in maps}
        weight = (weights.pop() if len(weights) == 1 and len(maps) == 1 else 0) + bool(early[s.name])
        plans.append(StarPlan(s, tuple(maps), frozenset(s.variables & outside), tuple(early[s.name]), weight))
    pushed = {id(f) for fs in early.values() for f in fs}
    try:
        ordered = order_stars(plans, edges, by_weight)
    except PlanError:
        if not cross_joins:
            raise
        ordered = plans
    return GroupPlan(tuple(ordered), tuple(edges), tuple(f for f in filters if id(f) not in pushed), g, transforms)
