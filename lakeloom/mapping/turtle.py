"""A reader for the part of Turtle that mappings use.

@prefix lines may lack their closing dot. Nested [ ] nodes become blank subjects.
"""

from __future__ import annotations

from ..sparql.ast import RDF_TYPE, Iri, Literal, Triple, Var
from ..sparql.parser import Cursor, QueryError
from ..sparql.tokens import unquote


class TurtleError(ValueError):
    pass


def read_turtle(text: str) -> list[Triple]:
    """Triples; blank nodes are variables named b0, b1, ..."""
    try:
        return _Reader(text).read()
    except QueryError as e:
        raise TurtleError(str(e)) from None


class _Reader(Cursor):
    def __init__(self, text: str):
        super().__init__(text)
        self.out: list[Triple] = []
        self.blanks = 0

    def read(self) -> list[Triple]:
        while self.now.kind != "end":
            if self.now.kind == "lang" and self.now.text in ("@prefix", "@base") or self.sees("PREFIX", "BASE"):
                self.directive(self.next().text.lstrip("@").lower())
            else:
                self.properties(self.node())
                self.need(".")
        return self.out

    def directive(self, kind: str) -> None:
        name = "" if kind == "base" else self.next().text[:-1]
        if self.now.kind != "iri":
            raise self.fail("an IRI")
        target = self.next().text[1:-1]
        if kind == "base":
            self.base = target
        else:
            self.prefixes[name] = target
        self.take(".")

    def node(self):
        token = self.now
        if token.kind in ("iri", "pname"):
            return self.resolve(self.next())
        if token.kind == "string":
            value = unquote(self.next().text)
            if self.take("^^"):
                return Literal(value, self.resolve(self.next()).value)
            return Literal(value, None, self.next().text[1:] if self.now.kind == "lang" else None)
        if token.kind == "number":
            return Literal(self.next().text)
        if self.take("TRUE", "FALSE"):
            return Literal(token.text)
        if self.take("["):
            blank = Var(f"b{self.blanks}")
            self.blanks += 1
            if not self.sees("]"):
                self.properties(blank)
            self.need("]")
            return blank
        raise self.fail("a node")

    def properties(self, subject) -> None:
        if self.sees(".", "]"):
            return
        while True:
            if self.now.kind == "name" and self.now.text == "a":
                self.next()
                predicate = Iri(RDF_TYPE)
            else:
                predicate = self.node()
            while True:
                self.out.append(Triple(subject, predicate, self.node()))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.sees(".", "]"):
                return
