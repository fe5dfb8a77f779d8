"""Syntax tree of a query. All nodes are immutable."""

from __future__ import annotations

from dataclasses import dataclass, field

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Literal:
    lex: str
    datatype: str | None = None
    lang: str | None = None

    @property
    def is_number(self) -> bool:
        return self.datatype is not None and self.datatype.removeprefix(XSD) in ("integer", "decimal", "double", "float", "int", "long")


Term = Var | Iri | Literal


@dataclass(frozen=True)
class Triple:
    subject: Term
    predicate: Iri
    object: Term


@dataclass(frozen=True)
class Op:
    """An operator or function over expressions: = != < <= > >= && || ! + - * / neg in, or a built-in's name."""

    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Aggregate:
    fn: str
    arg: Expr | None
    distinct: bool = False
    separator: str = " "


Expr = Var | Iri | Literal | Op | Aggregate


@dataclass(frozen=True)
class Values:
    variables: tuple[Var, ...]
    rows: tuple[tuple[Literal | Iri | None, ...], ...]


@dataclass(frozen=True)
class Group:
    """A group pattern: triples, then what is joined to them, then filters over all."""

    triples: tuple[Triple, ...] = ()
    filters: tuple[Expr, ...] = ()
    optionals: tuple[Group, ...] = ()
    unions: tuple[tuple[Group, ...], ...] = ()
    minus: tuple[Group, ...] = ()
    binds: tuple[tuple[Expr, Var], ...] = ()
    values: tuple[Values, ...] = ()


@dataclass(frozen=True)
class Call:
    """One function of a transformation chain."""

    name: str
    args: tuple[str, ...] = ()


@dataclass(frozen=True)
class JoinTransform:
    """Functions for one side of the join from `left`'s object to the subject `right`."""

    left: Var
    right: Var
    side: str
    calls: tuple[Call, ...]


@dataclass(frozen=True)
class Query:
    select: tuple[tuple[Expr, str], ...]
    where: Group
    distinct: bool = False
    group_by: tuple[tuple[Expr, str], ...] = ()
    having: tuple[Expr, ...] = ()
    order_by: tuple[tuple[Expr, bool], ...] = ()
    limit: int | None = None
    offset: int = 0
    transforms: tuple[JoinTransform, ...] = ()
    select_all: bool = False
    prefixes: dict[str, str] = field(default_factory=dict, hash=False)


def variables(e: Expr | None) -> set[str]:
    """Names of the variables of an expression."""
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Op):
        return set().union(*map(variables, e.args)) if e.args else set()
    return variables(e.arg) if isinstance(e, Aggregate) else set()


def has_aggregate(e: Expr) -> bool:
    return isinstance(e, Aggregate) or isinstance(e, Op) and any(map(has_aggregate, e.args))
