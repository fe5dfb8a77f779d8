"""Recursive-descent parser for SELECT queries with join transformations.

Supported: PREFIX, BASE, SELECT [DISTINCT] of variables, * and (expression AS ?v); basic graph
patterns with ; and , lists; FILTER with boolean, arithmetic and built-in expressions; OPTIONAL,
UNION, MINUS, BIND, VALUES; GROUP BY, HAVING, ORDER BY, LIMIT, OFFSET; and
TRANSFORM(?l?r.side.f.g(x) && ...) after the pattern or the modifiers. Anything else is a
QueryError that names it.
"""

from __future__ import annotations

from . import ast
from .ast import Aggregate, Expr, Group, Iri, Literal, Op, Term, Triple, Var
from .tokens import Token, TokenError, tokenize, unquote

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT")
BUILTINS = (
    "regex", "like", "bound", "str", "strlen", "ucase", "lcase", "contains", "strstarts", "strends", "strbefore", "strafter", "substr",
    "replace", "concat", "abs", "ceil", "floor", "round", "year", "month", "day", "hours", "minutes", "seconds", "if", "coalesce",
    "isnumeric", "isliteral", "isiri", "isuri", "isblank", "sameterm",
)
UNSUPPORTED = ("GRAPH", "SERVICE", "EXISTS", "ASK", "CONSTRUCT", "DESCRIBE", "FROM", "NAMED")


class QueryError(ValueError):
    """The text is no query of this language."""


class Cursor:
    """A position in a list of tokens, with the prefixes seen so far."""

    def __init__(self, text: str):
        try:
            self.tokens = tokenize(text)
        except TokenError as e:
            raise QueryError(str(e)) from None
        self.at = 0
        self.prefixes: dict[str, str] = {}
        self.base = ""

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, wanted: str) -> QueryError:
        return QueryError(f"{wanted} expected at {self.now.at}, found {self.now.text or 'the end'!r}")

    def next(self) -> Token:
        token = self.now
        self.at += 1
        return token

    def sees(self, *words: str) -> bool:
        return self.now.kind in ("name", "op") and self.now.text.upper() in words

    def take(self, *words: str) -> str | None:
        return self.next().text.upper() if self.sees(*words) else None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise self.fail(word)

    def resolve(self, token: Token) -> Iri:
        if token.kind == "iri":
            body = token.text[1:-1]
            return Iri(body if ":" in body or not self.base else self.base + body)
        prefix, _, local = token.text.partition(":")
        if prefix not in self.prefixes:
            raise QueryError(f"prefix {prefix!r} is not declared")
        return Iri(self.prefixes[prefix] + local)


def parse_query(text: str) -> ast.Query:
    return _Parser(text).query()


class _Parser(Cursor):
    def query(self) -> ast.Query:
        while word := self.take("PREFIX", "BASE"):
            if word == "BASE":
                self.base = self.next().text[1:-1]
                continue
            name = self.next()
            if name.kind != "pname" or not name.text.endswith(":") or self.now.kind != "iri":
                raise self.fail("a prefix and its IRI")
            self.prefixes[name.text[:-1]] = self.next().text[1:-1]
        if self.sees(*UNSUPPORTED):
            raise QueryError(f"{self.now.text.upper()} is not supported")
        self.need("SELECT")
        distinct = bool(self.take("DISTINCT", "REDUCED"))
        select, everything = self.select_list()
        if self.sees(*UNSUPPORTED):
            raise QueryError(f"{self.now.text.upper()} is not supported")
        self.take("WHERE")
        where = self.group()
        transforms = self.transforms()
        group_by, having, order_by, limit, offset = [], [], [], None, 0
        if self.take("GROUP"):
            self.need("BY")
            while self.now.kind == "var" or self.sees("("):
                group_by.append(self.projected("("))
        if self.take("HAVING"):
            while self.sees("(") or self.now.kind == "name" and self.now.text.lower() in BUILTINS:
                having.append(self.primary())
        if self.take("ORDER"):
            self.need("BY")
            while self.now.kind == "var" or self.sees("ASC", "DESC", "("):
                order = self.take("ASC", "DESC")
                order_by.append((self.primary(), order != "DESC"))
            if not order_by:
                raise self.fail("an order key")
        while word := self.take("LIMIT", "OFFSET"):
            number = int(self.number().lex)
            limit, offset = (number, offset) if word == "LIMIT" else (limit, number)
        transforms += self.transforms()
        if self.now.kind != "end":
            raise QueryError(f"{self.now.text!r} at {self.now.at} is not supported here")
        return ast.Query(tuple(select), where, distinct, tuple(group_by), tuple(having), tuple(order_by), limit, offset, tuple(transforms), everything, dict(self.prefixes))

    def projected(self, opening: str) -> tuple[Expr, str]:
        if self.now.kind == "var":
            name = self.next().text[1:]
            return Var(name), name
        self.need(opening)
        e = self.expr()
        if self.take("AS"):
            name = self.next().text[1:]
        else:
            name = e.name if isinstance(e, Var) else f"_{self.at}"
        self.need(")")
        return e, name

    def select_list(self) -> tuple[list[tuple[Expr, str]], bool]:
        if self.take("*"):
            return [], True
        out = []
        while self.now.kind == "var" or self.sees("("):
            out.append(self.projected("("))
        if not out:
            raise self.fail("a selected variable")
        return out, False

    # -- patterns --

    def group(self) -> Group:
        self.need("{")
        parts: dict[str, list] = {k: [] for k in ("triples", "filters", "optionals", "unions", "minus", "binds", "values")}
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("FILTER"):
                parts["filters"].append(self.primary())
            elif self.take("OPTIONAL"):
                parts["optionals"].append(self.group())
            elif self.take("MINUS"):
                parts["minus"].append(self.group())
            elif self.take("BIND"):
                parts["binds"].append(self.bound())
            elif self.take("VALUES"):
                parts["values"].append(self.inline())
            elif self.sees("{"):
                if self.tokens[self.at + 1].text.upper() == "SELECT":
                    raise QueryError("sub-SELECT is not supported")
                either = [self.group()]
                while self.take("UNION"):
                    either.append(self.group())
                parts["unions"].append(tuple(either))
            elif self.sees(*UNSUPPORTED):
                raise QueryError(f"{self.now.text.upper()} is not supported")
            elif self.now.kind == "end":
                raise self.fail("}")
            else:
                parts["triples"] += self.triples()
        return Group(**{k: tuple(v) for k, v in parts.items()})

    def bound(self) -> tuple[Expr, Var]:
        self.need("(")
        e = self.expr()
        self.need("AS")
        name = Var(self.next().text[1:])
        self.need(")")
        return e, name

    def inline(self) -> ast.Values:
        names: list[Var] = []
        many = bool(self.take("("))
        while self.now.kind == "var":
            names.append(Var(self.next().text[1:]))
            if not many:
                break
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.take("}"):
            if many:
                self.need("(")
            rows.append(tuple(None if self.take("UNDEF") else self.constant() for _ in names))
            if many:
                self.need(")")
        return ast.Values(tuple(names), tuple(rows))

    def constant(self) -> Literal | Iri:
        term = self.term()
        if isinstance(term, Var):
            raise QueryError("VALUES holds constants only")
        return term

    def triples(self) -> list[Triple]:
        subject, out = self.term(), []
        while True:
            predicate = self.verb()
            while True:
                out.append(Triple(subject, predicate, self.term()))
                if not self.take(","):
                    break
            while self.take(";"):
                if self.sees(";"):
                    continue
                break
            else:
                return out
            if self.sees(".", "}"):
                return out

    def verb(self) -> Iri:
        if self.now.kind == "name" and self.now.text == "a":
            self.next()
            return Iri(ast.RDF_TYPE)
        if self.now.kind == "var":
            raise QueryError("variables as predicates are not supported")
        if self.now.kind not in ("iri", "pname"):
            raise self.fail("a predicate")
        out = self.resolve(self.next())
        if self.sees("/", "|", "*", "+", "^"):
            raise QueryError("property paths are not supported")
        return out

    def number(self) -> Literal:
        sign = self.take("+", "-") or ""
        if self.now.kind != "number":
            raise self.fail("a number")
        text = self.next().text
        kind = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
        return Literal(("-" if sign == "-" else "") + text, ast.XSD + kind)

    def term(self) -> Term:
        token = self.now
        if token.kind == "var":
            return Var(self.next().text[1:])
        if token.kind in ("iri", "pname"):
            return self.resolve(self.next())
        if token.kind == "string":
            text = unquote(self.next().text)
            if self.now.kind == "lang":
                return Literal(text, None, self.next().text[1:])
            if self.take("^^"):
                return Literal(text, self.resolve(self.next()).value)
            return Literal(text)
        if token.kind == "number" or self.sees("+", "-"):
            return self.number()
        if word := self.take("TRUE", "FALSE"):
            return Literal(word.lower(), ast.XSD + "boolean")
        raise QueryError("blank nodes are not supported") if self.sees("[") else self.fail("a term")

    # -- expressions --

    def chain(self, ops: tuple[str, ...], below) -> Expr:
        left = below()
        while op := self.take(*ops):
            left = Op(op, (left, below()))
        return left

    def expr(self) -> Expr:
        return self.chain(("||",), lambda: self.chain(("&&",), self.relation))

    def relation(self) -> Expr:
        left = self.sum()
        if op := self.take("=", "!=", "<", "<=", ">", ">="):
            return Op(op, (left, self.sum()))
        negated = self.sees("NOT") and self.tokens[self.at + 1].text.upper() == "IN"
        if negated:
            self.next()
        if self.take("IN"):
            found = Op("in", (left, *self.arguments()))
            return Op("!", (found,)) if negated else found
        return left

    def sum(self) -> Expr:
        return self.chain(("+", "-"), lambda: self.chain(("*", "/"), self.unary))

    def unary(self) -> Expr:
        if self.take("!"):
            return Op("!", (self.unary(),))
        if self.take("-"):
            inner = self.unary()
            return Literal("-" + inner.lex, inner.datatype) if isinstance(inner, Literal) and inner.is_number else Op("neg", (inner,))
        self.take("+")
        return self.primary()

    def arguments(self) -> tuple[Expr, ...]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expr())
            if not self.sees(")"):
                self.need(",")
        return tuple(out)

    def primary(self) -> Expr:
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.now.kind == "name" and not self.sees("TRUE", "FALSE"):
            name = self.next().text
            if name.upper() in AGGREGATES:
                return self.aggregate(name.upper())
            if name.lower() in BUILTINS:
                return Op(name.lower(), self.arguments())
            raise QueryError(f"{name} is not supported in expressions")
        return self.term()

    def aggregate(self, fn: str) -> Aggregate:
        self.need("(")
        distinct, separator = bool(self.take("DISTINCT")), " "
        arg = None if self.take("*") else self.expr()
        if self.take(";"):
            self.need("SEPARATOR")
            self.need("=")
            separator = unquote(self.next().text)
        self.need(")")
        if arg is None and fn != "COUNT":
            raise QueryError(f"{fn}(*) is not supported")
        return Aggregate(fn, arg, distinct, separator)

    # -- join transformations --

    def transforms(self) -> list[ast.JoinTransform]:
        out = []
        if not self.take("TRANSFORM"):
            return out
        self.need("(")
        while True:
            if self.now.kind != "var" or self.tokens[self.at + 1].kind != "var":
                raise self.fail("two variables")
            left, right = Var(self.next().text[1:]), Var(self.next().text[1:])
            self.need(".")
            side = (self.take("L", "R") or "").lower()
            if not side:
                raise self.fail("l or r")
            calls = []
            while self.take("."):
                name = self.next().text
                calls.append(ast.Call(name, tuple(self.raw_arguments()) if self.take("(") else ()))
            if not calls:
                raise self.fail("a function")
            out.append(ast.JoinTransform(left, right, side, tuple(calls)))
            if not self.take("&&"):
                break
        self.need(")")
        return out

    def raw_arguments(self) -> list[str]:
        """Arguments as text: a string's value, or the tokens up to , or ) put together."""
        out, part, quoted = [], "", False
        while not self.sees(")"):
            token = self.next()
            if token.kind == "end":
                raise self.fail(")")
            if token.kind == "op" and token.text == ",":
                out.append(part)
                part, quoted = "", False
            else:
                part += unquote(token.text) if token.kind == "string" else token.text
                quoted |= token.kind == "string"
        self.need(")")
        return [*out, part] if part or out or quoted else out
