"""Triples maps: which attributes of which source answer which predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..sparql.ast import XSD, Call, Iri, Literal, Var
from .turtle import read_turtle

RR, RML, NOSQL = "http://www.w3.org/ns/r2rml#", "http://semweb.mmlab.be/ns/rml#", "http://purl.org/db/nosql#"
FNML, FNO = "http://semweb.mmlab.be/ns/fnml#", "https://w3id.org/function/ontology#"


class MappingError(ValueError):
    pass


@dataclass(frozen=True)
class Attribute:
    """A source attribute, the functions applied to it and an optional datatype IRI."""

    name: str
    calls: tuple[Call, ...] = ()
    datatype: str | None = None


@dataclass(frozen=True)
class TriplesMap:
    name: str
    source: str
    store: str
    template: str
    subject: Attribute
    classes: frozenset[str]
    predicates: dict[str, Attribute] = field(hash=False)

    def answers(self, predicates: set[str], classes: set[str]) -> bool:
        return predicates <= self.predicates.keys() and classes <= self.classes


@dataclass(frozen=True)
class Mapping:
    maps: tuple[TriplesMap, ...]

    def candidates(self, predicates: set[str], classes: set[str]) -> list[TriplesMap]:
        return [m for m in self.maps if m.answers(predicates, classes)]


def local_name(iri: str) -> str:
    return re.split(r"[#/]", iri)[-1]


def template_key(template: str) -> str:
    """The attribute in the last braces of a subject template."""
    found = re.findall(r"\{([^{}]+)\}", template)
    if not found:
        raise MappingError(f"template {template!r} names no attribute")
    return found[-1]


def load_mapping(text: str) -> Mapping:
    index: dict[object, dict[str, list]] = {}
    for t in read_turtle(text):
        index.setdefault(t.subject, {}).setdefault(t.predicate.value, []).append(t.object)

    def many(node, *iris: str) -> list:
        return [o for iri in iris for o in index.get(node, {}).get(iri, [])]

    def one(node, *iris: str):
        return next(iter(many(node, *iris)), None)

    def text_of(node) -> str | None:
        return node.lex if isinstance(node, Literal) else node.value if isinstance(node, Iri) else None

    def function(node) -> Attribute | None:
        """The attribute and call of a node with a function value."""
        value = one(node, FNML + "functionValue")
        if value is None:
            return None
        name, attribute, args = None, None, []
        for po in many(value, RR + "predicateObjectMap"):
            obj = one(po, RR + "objectMap")
            constant, reference = one(obj, RR + "constant"), one(obj, RR + "reference", RML + "reference")
            if (local_name(text_of(one(po, RR + "predicate")) or "")) == "executes":
                name = local_name(text_of(constant or one(po, RR + "object")))
            elif reference is not None:
                attribute = text_of(reference)
            elif constant is not None:
                args.append(text_of(constant))
            elif isinstance(obj, Iri | Var) and (inner := function(obj)):
                attribute = inner
        if name is None or attribute is None:
            raise MappingError("a function value needs a function and an attribute")
        inner = attribute if isinstance(attribute, Attribute) else Attribute(attribute)
        return Attribute(inner.name, (*inner.calls, Call(name, tuple(args))))

    def attribute(node) -> Attribute | None:
        found = function(node)
        if found is None and (reference := one(node, RML + "reference", RR + "reference", RR + "column")) is not None:
            found = Attribute(text_of(reference))
        datatype = text_of(one(node, RR + "datatype"))
        return Attribute(found.name, found.calls, datatype) if found else None

    maps = []
    for node, facts in index.items():
        if RML + "logicalSource" not in facts or RR + "subjectMap" not in facts:
            continue
        source, subject = one(node, RML + "logicalSource"), one(node, RR + "subjectMap")
        template, name = text_of(one(subject, RR + "template")), text_of(node) or str(node)
        if template is None or text_of(one(source, RML + "source")) is None:
            raise MappingError(f"{name} needs a source and a subject template")
        predicates = {}
        for po in many(node, RR + "predicateObjectMap"):
            predicate, found = text_of(one(po, RR + "predicate")), attribute(one(po, RR + "objectMap"))
            if predicate is None or found is None:
                raise MappingError(f"a predicate of {name} has no attribute")
            predicates[predicate] = found
        own = function(subject)
        key = Attribute(template_key(template), own.calls if own else (), text_of(one(subject, RR + "datatype")))
        store = local_name(text_of(one(source, NOSQL + "store")) or "csv").lower()
        maps.append(TriplesMap(name, text_of(one(source, RML + "source")), store, template, key, frozenset(text_of(c) for c in many(subject, RR + "class")), predicates))
    return Mapping(tuple(maps))


SPARK_TYPES = {XSD + k: v for k, v in {"integer": "bigint", "int": "int", "long": "bigint", "decimal": "decimal(38,10)", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "dateTime": "timestamp", "string": "string"}.items()}
