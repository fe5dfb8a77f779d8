from __future__ import annotations

import pytest

from lakeloom.mapping import load_config, load_mapping
from lakeloom.mapping.config import ConfigError
from lakeloom.mapping.rml import MappingError
from lakeloom.mapping.turtle import TurtleError, read_turtle

HEAD = """@prefix rr: <http://www.w3.org/ns/r2rml#>
@prefix rml: <http://semweb.mmlab.be/ns/rml#>   # a comment
@prefix nosql: <http://purl.org/db/nosql#>
@prefix v: <http://v/>

"""
ONE = HEAD + """<#M> rml:logicalSource [ rml:source "a#b.csv"; nosql:store nosql:mongodb ];
  rr:subjectMap [ rr:template "http://e/{nr}"; rr:class v:P , v:Q ];
  rr:predicateObjectMap [ rr:predicate v:x; rr:objectMap [ rml:reference "cx"; rr:datatype <http://www.w3.org/2001/XMLSchema#double> ] ] ."""


def test_triples_map():
    m = load_mapping(ONE).maps[0]
    assert (m.source, m.store, m.subject.name, m.classes) == ("a#b.csv", "mongodb", "nr", {"http://v/P", "http://v/Q"})
    assert m.predicates["http://v/x"].name == "cx" and m.predicates["http://v/x"].datatype.endswith("double")


def test_candidates_need_all_predicates_and_the_class():
    m = load_mapping(ONE)
    assert m.candidates({"http://v/x"}, {"http://v/P"}) and not m.candidates({"http://v/x", "http://v/y"}, set()) and not m.candidates(set(), {"http://v/Z"})


def test_bad_mappings():
    with pytest.raises(MappingError, match="template"):
        load_mapping(ONE.replace("{nr}", "nr"))
    with pytest.raises(TurtleError):
        read_turtle(HEAD + "<#a> v:b [ v:c 1 .")


def test_config_with_comment_lines():
    c = load_config('# one\n  # two\n{"sources": [{"type": "csv", "source": "s", "options": {"header": true}}], "weights": [{"datasource": "CSV", "weight": 9}]}')
    assert c.options_of("s") == {"header": "True"} and c.options_of("t") == {} and c.weight_of("csv") == 9 and c.weight_of("jdbc") == 4
    with pytest.raises(ConfigError):
        load_config('{"sources": [{"type": "csv"}]}')
