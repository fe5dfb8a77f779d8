from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.sparql import QueryError, parse_query
from lakeloom.sparql.ast import Aggregate, Iri, Literal, Op, Var
from lakeloom.sparql.tokens import unquote

HEAD = "PREFIX p: <http://x.y/n.s#>\n"


def test_lists_of_predicates_and_objects():
    q = parse_query(HEAD + 'SELECT ?a WHERE { ?s a p:C ; p:x ?a , "l"@en ; p:y 1.5 . ?t <http://z/q.r> ?s ; . }')
    assert len(q.where.triples) == 5
    assert q.where.triples[2].object == Literal("l", None, "en")
    assert q.where.triples[4].predicate == Iri("http://z/q.r")


def test_filters_keep_structure():
    q = parse_query(HEAD + 'SELECT * { ?s p:x ?a . FILTER(?a <= -3 && !(?a = "b" || regex(?a, "c", "i"))) }')
    top = q.where.filters[0]
    assert top.name == "&&" and top.args[0] == Op("<=", (Var("a"), Literal("-3", "http://www.w3.org/2001/XMLSchema#integer")))
    assert top.args[1].name == "!" and top.args[1].args[0].name == "||"
    assert q.select_all


def test_modifiers_in_order():
    q = parse_query(HEAD + "SELECT ?a (COUNT(DISTINCT ?b) AS ?n) { ?a p:x ?b } GROUP BY ?a HAVING (COUNT(?b) > 2) ORDER BY DESC(?n) ?a LIMIT 5 OFFSET 2")
    assert q.select[1] == (Aggregate("COUNT", Var("b"), True), "n")
    assert q.order_by == ((Var("n"), False), (Var("a"), True))
    assert (q.limit, q.offset) == (5, 2)


def test_transform_clause_before_or_after_modifiers():
    clause = 'TRANSFORM(?l?r.l.toInt.scl(+61) && ?l?r.r.replc("a.b", ""))'
    for text in (f"{{ ?l p:x ?r . ?r p:y ?z }} {clause} LIMIT 3", f"{{ ?l p:x ?r . ?r p:y ?z }} LIMIT 3 {clause}"):
        q = parse_query(HEAD + "SELECT ?z " + text)
        assert [(t.side, [(c.name, c.args) for c in t.calls]) for t in q.transforms] == [("l", [("toInt", ()), ("scl", ("+61",))]), ("r", [("replc", ("a.b", ""))])]


@pytest.mark.parametrize(("text", "named"), [
    ("ASK { ?s p:x ?o }", "ASK"), ("SELECT ?a { GRAPH ?g { ?s p:x ?a } }", "GRAPH"), ("SELECT ?a { ?s ?p ?a }", "predicates"), ("SELECT ?a { ?s p:x/p:y ?a }", "property paths"),
    ("SELECT ?a { { SELECT ?a { ?s p:x ?a } } }", "sub-SELECT"), ("SELECT ?a { ?s q:x ?a }", "prefix"), ("SELECT ?a { ?s p:x ?a", "}"), ("SELECT ?a { ?s p:x [] }", "blank nodes"), ("SELECT ?a { ?s p:x ?a FILTER(md5(?a)) }", "md5"),
])
def test_unsupported_is_named(text, named):
    with pytest.raises(QueryError, match=named.replace("}", r"\}")):
        parse_query(HEAD + text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=20))
def test_string_literals_round_trip(value):
    quoted = '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
    assert unquote(quoted) == value
    assert parse_query(HEAD + f"SELECT ?s {{ ?s p:x {quoted} }}").where.triples[0].object == Literal(value)
