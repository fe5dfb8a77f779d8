"""Features of a planned query."""

from __future__ import annotations

from ..plans.stars import GroupPlan
from ..sparql import ast
from ..sparql.ast import Op

FEATURES = ("stars", "joins", "filters_equal", "filters_range", "filters_other", "projected", "sources", "distinct", "grouped", "order_keys", "limit")


def _kind(e) -> str:
    name = e.name if isinstance(e, Op) else ""
    return "filters_equal" if name == "=" else "filters_range" if name in ("<", "<=", ">", ">=") else "filters_other"


def plan_features(q: ast.Query, plan: GroupPlan) -> dict[str, float]:
    out = dict.fromkeys(FEATURES, 0.0)
    filters = [*plan.filters, *(f for p in plan.stars for f in p.filters)]
    for f in filters:
        out[_kind(f)] += 1
    constants = sum(isinstance(o, ast.Literal | ast.Iri) for p in plan.stars for _, o in p.star.patterns)
    out["filters_equal"] += constants
    out |= {
        "stars": len(plan.stars), "joins": len(plan.edges), "projected": len(q.select), "sources": sum(len(p.maps) for p in plan.stars),
        "distinct": float(q.distinct), "grouped": float(bool(q.group_by)), "order_keys": len(q.order_by), "limit": float(q.limit is not None),
    }
    return {k: float(v) for k, v in out.items()}
