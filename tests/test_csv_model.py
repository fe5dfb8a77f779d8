"""Joins, filters, groups and orders over text columns of CSV files, in both models, against plain Python.

Ships make voyages between harbours. The files hold negative and fractional numbers, text that is no number, quoted
commas, empty fields, a line with too many fields, and voyages of ships that do not exist.
"""

from __future__ import annotations

import csv
from collections import Counter

import pytest

from lakeloom.engine import Engine
from lakeloom.tables import HEAD, PREFIXES, turtle_map

HARBOURS = [{"code": f"H{i}", "town": ["Oslo", "Porto, Norte", "Riga"][i % 3], "depth": ["7.5", "12", "-1", "unknown"][i % 4]} for i in range(9)]
SHIPS = [{"no": str(i), "title": f"Ship {i % 5}", "home": f"H{i % 11}", "tons": ["900", "1200.5", "n/a", ""][i % 4]} for i in range(20)]
VOYAGES = [{"id": str(i), "ship": str(i * 7 % 24), "target": f"H{i * 5 % 9}", "days": ["3", "14", "2.5"][i % 3]} for i in range(120)]
FILES = {
    "Harbour": ("code", {"town": "town", "depth": "depth"}, HARBOURS),
    "Ship": ("no", {"title": "title", "home": "home", "tons": "tons"}, SHIPS),
    "Voyage": ("id", {"byship": "ship", "target": "target", "days": "days"}, VOYAGES),
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("fleet")
    for name, (_, _, rows) in FILES.items():
        with (folder / f"{name}.csv").open("w", newline="") as f:
            writer = csv.DictWriter(f, rows[0].keys())
            writer.writeheader()
            writer.writerows(rows)
            f.write("one,line,with,more,fields,than,there,are\n")
    maps = "".join(turtle_map(n, f"{folder}/{n}.csv", "csv", key, columns) for n, (key, columns, _) in FILES.items())
    sources = ", ".join(f'{{"type": "csv", "source": "{folder}/{n}.csv", "options": {{"header": "true", "mode": "DROPMALFORMED"}}}}' for n in FILES)
    return Engine(spark, PREFIXES + maps, f'{{"sources": [{sources}]}}')


def value(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return float("nan")


BY_NO, BY_CODE = {s["no"]: s for s in SHIPS}, {h["code"]: h for h in HARBOURS}
CASES = {
    "numbers in text": ("SELECT ?h ?t WHERE { ?h a tp:Harbour ; tp:town ?t ; tp:depth ?d . FILTER(?d > -2 && ?d < 10) }", [(h["code"], h["town"]) for h in HARBOURS if -2 < value(h["depth"]) < 10]),
    "an empty field is no binding": ("SELECT ?s ?x WHERE { ?s a tp:Ship ; tp:tons ?x }", [(s["no"], s["tons"]) for s in SHIPS if s["tons"]]),
    "dangling keys join nothing": ("SELECT ?v ?n WHERE { ?v a tp:Voyage ; tp:byship ?s . ?s tp:title ?n }", [(v["id"], BY_NO[v["ship"]]["title"]) for v in VOYAGES if v["ship"] in BY_NO]),
    "two ways to a harbour": (
        "SELECT ?v ?from ?to WHERE { ?v a tp:Voyage ; tp:byship ?s ; tp:target ?b . ?s tp:home ?a . ?a tp:town ?from . ?b tp:town ?to . FILTER(?from != ?to) }",
        [(v["id"], x, y) for v in VOYAGES if v["ship"] in BY_NO and BY_NO[v["ship"]]["home"] in BY_CODE and (x := BY_CODE[BY_NO[v["ship"]]["home"]]["town"]) != (y := BY_CODE[v["target"]]["town"])],
    ),
    "groups": ("SELECT ?t (COUNT(?v) AS ?n) WHERE { ?v a tp:Voyage ; tp:target ?h ; tp:days ?d . ?h tp:town ?t . FILTER(?d >= 2.75) } GROUP BY ?t", list(Counter(BY_CODE[v["target"]]["town"] for v in VOYAGES if value(v["days"]) >= 2.75).items())),
    "distinct": ("SELECT DISTINCT ?n WHERE { ?s a tp:Ship ; tp:title ?n }", sorted({(s["title"],) for s in SHIPS})),
}


@pytest.mark.parametrize("model", ["tabular", "graph"])
@pytest.mark.parametrize("case", list(CASES))
def test_case(engine, case, model):
    text, want = CASES[case]
    assert want and sorted(map(tuple, engine.query(HEAD + text, model).run())) == sorted(want)


@pytest.mark.parametrize("model", ["tabular", "graph"])
def test_order_and_limit(engine, model):
    rows = engine.query(HEAD + "SELECT ?v ?n WHERE { ?v a tp:Voyage ; tp:byship ?s . ?s tp:title ?n } ORDER BY DESC(?n) ?v LIMIT 10", model).run()
    pairs = [(v["id"], BY_NO[v["ship"]]["title"]) for v in VOYAGES if v["ship"] in BY_NO]
    assert [tuple(r) for r in rows] == sorted(sorted(pairs), key=lambda x: x[1], reverse=True)[:10]
