from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeloom.engine import Engine
from lakeloom.operators.graph import edges_of, triplets, vertices_of
from lakeloom.plans import PlanError
from lakeloom.plans.stars import NoSourceError, join_edges, stars_of
from lakeloom.selector import FEATURES, Selector, fit_selector
from lakeloom.selector.model import regret
from lakeloom.sources import SourceError, default_registry
from lakeloom.sources.registry import connector_options
from lakeloom.sparql import QueryError, parse_query
from lakeloom.tables import HEAD, PREFIXES, mapping_for, turtle_map


@pytest.fixture(scope="module")
def engine(spark, sf_dir):
    return Engine(spark, mapping_for(sf_dir))


def small(spark, tmp_path, rows, schema, predicates, key="k", cls="T", **options):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/t")
    return Engine(spark, PREFIXES + turtle_map(cls, f"{tmp_path}/t", "parquet", key, predicates), **options)


def test_plan_of_a_chain_with_a_cycle():
    q = parse_query(HEAD + "SELECT ?x { ?a tp:p ?b . ?b tp:q ?c ; tp:r ?x . ?c tp:s ?a . ?d tp:t ?x }")
    edges = join_edges(stars_of(q.where.triples))
    assert [(e.left, e.right) for e in edges] == [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")]
    assert edges[3].predicate is None and edges[3].variable == "x"


def test_pushdown_and_pruning_reach_the_scan(engine):
    plan = engine.query(HEAD + "SELECT ?c ?n { ?o a tp:Orders ; tp:customer ?c ; tp:totalprice ?t . ?c tp:custname ?n FILTER(?t > 100000) }").df._jdf.queryExecution().toString()
    assert any("GreaterThan(o_totalprice,100000.0)" in x for x in plan.splitlines() if "PushedFilters" in x)
    assert "o_orderpriority" not in plan.split("Physical Plan")[1]


def test_topk_is_one_operator(engine):
    plan = engine.query(HEAD + "SELECT DISTINCT ?b { ?p a tp:Part ; tp:brand ?b } ORDER BY ?b LIMIT 3").df._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_strict_and_lenient_nulls(spark, tmp_path):
    rows, schema, predicates = [(1, "a"), (2, None), (None, "c")], "k long, v string", {"v": "v"}
    text = HEAD + "SELECT ?k ?v { ?k a tp:T ; tp:v ?v }"
    for model in ("tabular", "graph"):
        assert small(spark, tmp_path, rows, schema, predicates).query(text, model).run() == [(1, "a")]
        assert sorted(small(spark, tmp_path, rows, schema, predicates, strict=False).query(text, model).run(), key=repr) == [(1, "a"), (2, None), (None, "c")]


def test_text_columns_compare_with_numbers_and_dates(spark, tmp_path):
    e = small(spark, tmp_path, [(1, "7683.53", "2001-02-03"), (2, "90", "1999-01-01"), (3, "x", "y")], "k long, p string, d string", {"p": "p", "d": "d"})
    run = lambda f: sorted(r[0] for r in e.query(HEAD + f"SELECT ?k {{ ?k a tp:T ; tp:p ?p ; tp:d ?d FILTER({f}) }}").run())
    assert run("?p <= 1000") == [2] and run("?p > 100") == [1] and run('?p = "90"') == [2] and run("?p + 1 = 91") == [2]
    assert run('?d < "2000-01-01"^^xsd:date') == [2] and run('?d != "y"') == [1, 2] and run("year(?d) = 2001") == [1]


def test_empty_source_and_ties(spark, tmp_path):
    e = small(spark, tmp_path, [], "k long, v string", {"v": "v"})
    assert e.query(HEAD + "SELECT ?v { ?k a tp:T ; tp:v ?v }").run() == []
    assert e.query(HEAD + "SELECT (COUNT(*) AS ?n) { ?k a tp:T ; tp:v ?v }").run() == [(0,)]


def test_errors_are_named(engine):
    with pytest.raises(PlanError, match="falls apart"):
        engine.query(HEAD + "SELECT ?a { ?a a tp:Nation ; tp:nname ?x . ?b a tp:Region ; tp:rname ?y }")
    with pytest.raises(NoSourceError, match="nothing"):
        engine.query(HEAD + "SELECT ?a { ?a tp:nothing ?x }")
    with pytest.raises(QueryError, match="grouped"):
        engine.query(HEAD + "SELECT ?a (COUNT(?x) AS ?n) { ?a a tp:Nation ; tp:nname ?x } GROUP BY ?x")
    with pytest.raises(SourceError, match="no reader"):
        default_registry().read(None, "tape", "x", {})


def test_cross_join_is_opt_in(spark, sf_dir):
    e = Engine(spark, mapping_for(sf_dir), cross_joins=True)
    for model in ("tabular", "graph"):
        assert e.query(HEAD + "SELECT ?x ?y { ?a a tp:Nation ; tp:nname ?x . ?b a tp:Region ; tp:rname ?y }", model).count() == 125


def test_triplets_follow_foreign_keys(engine, spark, sf_dir):
    q = parse_query(HEAD + "SELECT ?n ?r { ?n a tp:Nation ; tp:nregion ?r . ?r tp:rname ?x }")
    edge = join_edges(stars_of(q.where.triples))[0]
    nations = engine.query(HEAD + "SELECT ?n ?r { ?n a tp:Nation ; tp:nregion ?r }").df
    regions = engine.query(HEAD + "SELECT ?r ?x { ?r a tp:Region ; tp:rname ?x }").df
    found = triplets(edges_of(edge, vertices_of("n", nations)), vertices_of("r", regions))
    assert found.count() == 25 and {r["dst"]["star"] for r in found.collect()} == {"r"}


def test_csv_drops_malformed_lines_whatever_is_selected(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v,w\n1,a,x\n2,"b,c",\n3,d\n4,null,z,extra\n5,e,y\n')
    options = '{"sources": [{"type": "csv", "source": "%s", "options": {"header": "true", "mode": "DROPMALFORMED"}}]}' % (tmp_path / "a.csv")
    e = Engine(spark, PREFIXES + turtle_map("T", str(tmp_path / "a.csv"), "csv", "id", {"v": "v", "w": "w"}), options)
    ids = lambda text: sorted(r[0] for r in e.query(HEAD + text).run())
    assert ids("SELECT ?s { ?s a tp:T ; tp:v ?v }") == ["1", "2", "5"] == ids("SELECT ?s { ?s a tp:T }")


def test_ntriples_types(spark, tmp_path):
    x = "http://www.w3.org/2001/XMLSchema#"
    t = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
    (tmp_path / "a.nt").write_text(
        f'<http://e/1> {t} <http://e/A> .\n<http://e/1> {t} <http://e/B> .\n<http://e/2> {t} <http://e/B> .\n<http://e/3> {t} <http://e/A> .\n<http://e/4> <http://e/d> "1" .\n'
        f'<http://e/1> <http://e/d> "1.5"^^<{x}double> .\n<http://e/1> <http://e/i> "7"^^<{x}integer> .\n<http://e/2> <http://e/i> "8"^^<{x}int> .\n<http://e/2> <http://e/i> "6"^^<{x}int> .\n'
        f'<http://e/1> <http://e/b> "true"^^<{x}boolean> .\n<http://e/1> <http://e/t> "2001-02-03T04:05:06"^^<{x}dateTime> .\n<http://e/2> <http://e/s> "a \\"b\\" . c" .\n# comment\nnot a triple\n'
    )
    df = default_registry().read(spark, "rdf", str(tmp_path / "a.nt"), {"class": "http://e/B"})
    rows = {r["id"]: r for r in df.collect()}
    assert set(rows) == {"e/1", "e/2"} and dict(df.dtypes)["e/d"] == "double" and dict(df.dtypes)["e/i"] == "array<int>" and dict(df.dtypes)["e/t"] == "timestamp"
    assert rows["e/1"]["e/i"] == [7] and rows["e/2"]["e/i"] == [6, 8] and rows["e/2"]["e/d"] is None and rows["e/1"]["e/b"] is True
    assert rows["e/2"]["e/s"] == 'a "b" . c' and rows["e/1"]["type_e/A"] == "1" and rows["e/2"]["type_e/A"] is None


@pytest.mark.parametrize(("store", "options", "fmt", "some"), [
    ("cassandra", {"keyspace": "k", "table": "t"}, "org.apache.spark.sql.cassandra", {"keyspace": "k", "table": "t"}), ("mongodb", {"url": "h:1", "database": "d", "collection": "c", "options": "x=1"}, "mongodb", {"connection.uri": "mongodb://h:1/?x=1", "database": "d", "collection": "c"}),
    ("neo4j", {"nodes": "Person", "database": "n"}, "org.neo4j.spark.DataSource", {"labels": ":Person", "database": "n"}), ("jdbc", {"url": "u", "user": "me"}, "jdbc", {"dbtable": "src", "url": "u"}), ("elasticsearch", {}, "org.elasticsearch.spark.sql", {"es.resource": "src"}),
])
def test_connector_options(store, options, fmt, some):
    got_fmt, got = connector_options(store, "src", options)
    assert got_fmt == fmt and some.items() <= got.items()


def test_partitioned_jdbc_needs_all_bounds():
    with pytest.raises(SourceError, match="lowerBound"):
        connector_options("jdbc", "t", {"partitionColumn": "id"})


def test_selector_learns_and_round_trips(spark):
    rows = [{**dict.fromkeys(FEATURES, 0.0), "joins": float(i % 6), "tabular_s": 1.0, "graph_s": 0.5 if i % 6 > 2 else 2.0} for i in range(60)]
    log = spark.createDataFrame(rows)
    fitted = fit_selector(log)
    assert Selector.from_json(fitted.to_json()) == fitted
    assert regret(log, fitted)["accuracy"] == 1.0 and fitted.choose({**dict.fromkeys(FEATURES, 0.0), "joins": 5.0}) == "graph"


def test_result_telemetry(engine):
    r = engine.query(HEAD + 'SELECT ?o { ?o a tp:Orders ; tp:orderstatus "F" ; tp:totalprice ?t FILTER(?t > 5) } ORDER BY ?o LIMIT 4', "auto")
    r.run()
    assert r.model == "tabular" and r.info["rows"] == 4 and r.info["filters_equal"] == 1 and r.info["filters_range"] == 1 and r.info["limit"] == 1
    assert set(r.timings) == {"analysis", "sources", "execution"} and r.memory()["parallelism"] >= 1


TABLE = st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 5)), st.sampled_from("ab")), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(a=TABLE, b=TABLE)
def test_random_tables_in_both_models(spark, tmp_path, a, b):
    for name, rows in (("a", a), ("b", b)):
        spark.createDataFrame(rows, "k long, f long, v string").write.mode("overwrite").parquet(f"{tmp_path}/{name}")
    maps = PREFIXES + turtle_map("A", f"{tmp_path}/a", "parquet", "k", {"af": "f", "av": "v"}) + turtle_map("B", f"{tmp_path}/b", "parquet", "k", {"bf": "f", "bv": "v"})
    e = Engine(spark, maps)
    text = HEAD + "SELECT ?x ?y ?v { ?x a tp:A ; tp:af ?y ; tp:av ?v . ?y a tp:B ; tp:bf ?x ; tp:bv ?v }"
    want = sorted((x, y, v) for x, y, v in a for k, f, w in b if y is not None and f is not None and (k, f, w) == (y, x, v))
    for model in ("tabular", "graph"):
        assert sorted(map(tuple, e.query(text, model).run())) == want
