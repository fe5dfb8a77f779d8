"""Registered queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .shared import scratch_folder
from .tables import HEAD, PREFIXES, TABLES, mapping_for, turtle_map

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WEIGHTS = '{"weights": [{"datasource": "parquet", "weight": 2}, {"datasource": "csv", "weight": 1}]}'


def add(name: str, text: str, sql: str, models: tuple[str, ...] = ("tabular",), build: Callable[[SparkSession, str], Engine] | None = None, **options) -> None:
    """Register a query; each model gets a key of its own, graph_... for the graph model."""

    def make(model: str) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            engine = build(spark, sf_dir) if build else Engine(spark, mapping_for(sf_dir), **options)
            return engine.query(HEAD + text, model).df

        return run

    for model in models:
        key = f"graph_{name}" if model == "graph" else name
        QUERIES[key], ORACLES[key] = make(model), sql


BOTH = ("tabular", "graph")

# -- scans, filters, projections --------------------------------------------------------------

add("star_scan_filter", """SELECT ?part ?name ?size WHERE { ?part a tp:Part ; tp:name ?name ; tp:brand ?brand ; tp:size ?size .
    FILTER(?brand = "Brand#11") FILTER(?size <= 10) }""", "SELECT p_partkey AS part, p_name AS name, p_size AS size FROM part WHERE p_brand = 'Brand#11' AND p_size <= 10", BOTH)  # fmt: skip
_OPS = "SELECT ?o ?price WHERE {{ ?o a tp:Orders ; tp:totalprice ?price ; tp:orderstatus ?s . FILTER({0}) }}"
for _name, _filter, _where in (
    ("eq", '?s = "F"', "o_orderstatus = 'F'"), ("ne", '?s != "F"', "o_orderstatus <> 'F'"), ("lt", "?price < 50000.5", "o_totalprice < 50000.5"), ("le", "?price <= 50000", "o_totalprice <= 50000"),
    ("gt", "?price > 250000", "o_totalprice > 250000"), ("ge", "?price >= 250000.25", "o_totalprice >= 250000.25"), ("reversed", "400000 <= ?price", "o_totalprice >= 400000"),
    ("boolean", '?price < 20000 || (?s = "P" && !(?price < 300000))', "o_totalprice < 20000 OR (o_orderstatus = 'P' AND NOT (o_totalprice < 300000))"),
    ("in", '?s IN ("F", "P") && ?price NOT IN (1, 2)', "o_orderstatus IN ('F', 'P') AND o_totalprice NOT IN (1, 2)"), ("arithmetic", "?price / 2 + 10 > 200000 - 5 * 3", "o_totalprice / 2 + 10 > 200000 - 15"),
):
    add(f"filter_{_name}", _OPS.format(_filter), f"SELECT o_orderkey AS o, o_totalprice AS price FROM orders WHERE {_where}", BOTH if _name in ("ne", "boolean") else ("tabular",))
add("filter_like", 'SELECT ?p ?n WHERE { ?p a tp:Part ; tp:name ?n . FILTER(like(?n, "%a_e%")) }', "SELECT p_partkey AS p, p_name AS n FROM part WHERE p_name LIKE '%a_e%'", BOTH)
add("filter_regex", 'SELECT ?p ?n WHERE { ?p a tp:Part ; tp:name ?n . FILTER regex(?n, "^[A-M].*E$", "i") }', "SELECT p_partkey AS p, p_name AS n FROM part WHERE regexp_matches(p_name, '^[A-M].*E$', 'i')", BOTH)
add("filter_typed_date", 'SELECT ?o ?d WHERE { ?o a tp:Orders ; tp:orderdate ?d . FILTER(?d >= "1998-01-01"^^xsd:date) }', "SELECT o_orderkey AS o, o_orderdate AS d FROM orders WHERE o_orderdate >= DATE '1998-01-01'")
add("constant_object", 'SELECT ?c ?n WHERE { ?c tp:mktsegment "BUILDING" ; tp:custname ?n }', "SELECT c_custkey AS c, c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING'", BOTH)
add("repeated_predicate", "SELECT ?a ?b WHERE { ?r a tp:Region ; tp:rname ?a , ?b }", "SELECT r_name AS a, r_name AS b FROM region")
add("distinct_project", "SELECT DISTINCT ?name ?brand WHERE { ?p a tp:Part ; tp:name ?name ; tp:brand ?brand }", "SELECT DISTINCT p_name AS name, p_brand AS brand FROM part", BOTH)
add("subject_project", "SELECT ?o ?price WHERE { ?o a tp:Orders ; tp:totalprice ?price }", "SELECT o_orderkey AS o, o_totalprice AS price FROM orders", BOTH)
add("subject_iri", "SELECT ?n ?name WHERE { ?n a tp:Nation ; tp:nname ?name }", "SELECT 'http://lakeloom.example/nation/' || n_nationkey AS n, n_name AS name FROM nation", iri=True)
add("builtin_functions", """SELECT ?c (ucase(?n) AS ?u) (strlen(?n) AS ?len) (substr(?n, 1, 8) AS ?head) (strafter(?n, "#") AS ?tail) (concat(?s, "-", ?n) AS ?both) (abs(?b) AS ?abs) (if(?b < 0, "debit", "credit") AS ?side)
    WHERE { ?c a tp:Customer ; tp:custname ?n ; tp:acctbal ?b ; tp:mktsegment ?s . FILTER(strstarts(?s, "B") || contains(?s, "MACH")) }""",
    """SELECT c_custkey AS c, upper(c_name) AS u, length(c_name)::INTEGER AS len, substr(c_name, 1, 8) AS head, split_part(c_name, '#', 2) AS tail, c_mktsegment || '-' || c_name AS both, abs(c_acctbal) AS abs,
    CASE WHEN c_acctbal < 0 THEN 'debit' ELSE 'credit' END AS side FROM customer WHERE starts_with(c_mktsegment, 'B') OR contains(c_mktsegment, 'MACH')""")  # fmt: skip
add("date_parts", "SELECT ?y ?m (COUNT(*) AS ?n) WHERE { ?o a tp:Orders ; tp:orderdate ?d } GROUP BY (year(?d) AS ?y) (month(?d) AS ?m)", "SELECT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, count(*) AS n FROM orders GROUP BY 1, 2")

# -- joins ------------------------------------------------------------------------------------

add("join_fk_id", "SELECT ?o ?c ?n WHERE { ?o a tp:Orders ; tp:customer ?c . ?c tp:custname ?n }", "SELECT o_orderkey AS o, o_custkey AS c, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey", BOTH)
add("join_chain", """SELECT ?line ?price ?n ?nation ?region WHERE { ?l a tp:Lineitem ; tp:order ?o ; tp:linenumber ?line ; tp:extendedprice ?price ; tp:quantity ?q .
    ?o tp:customer ?c . ?c tp:custname ?n ; tp:custnation ?k . ?k tp:nname ?nation ; tp:nregion ?r . ?r tp:rname ?region . FILTER(?q >= 49) }""",
    """SELECT l_linenumber AS line, l_extendedprice AS price, c_name AS n, n_name AS nation, r_name AS region FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity >= 49""", BOTH)  # fmt: skip
add("join_chain_all", """SELECT ?line ?price ?n ?nation ?region WHERE { ?l a tp:Lineitem ; tp:order ?o ; tp:linenumber ?line ; tp:extendedprice ?price .
    ?o tp:customer ?c . ?c tp:custname ?n ; tp:custnation ?k . ?k tp:nname ?nation ; tp:nregion ?r . ?r tp:rname ?region }""",
    """SELECT l_linenumber AS line, l_extendedprice AS price, c_name AS n, n_name AS nation, r_name AS region FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""", BOTH)  # fmt: skip
_MULTI = """SELECT ?status ?part ?supplier ?q WHERE { ?l a tp:Lineitem ; tp:order ?o ; tp:part ?p ; tp:supplier ?s ; tp:quantity ?q . ?o tp:orderstatus ?status . ?p tp:name ?part ; tp:size ?size .
    ?s tp:suppname ?supplier . FILTER(?size = 7) }"""
_MULTI_SQL = """SELECT o_orderstatus AS status, p_name AS part, s_name AS supplier, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey WHERE p_size = 7"""
add("join_star_multi", _MULTI, _MULTI_SQL, BOTH, by_weight=False)
add("join_reordered", _MULTI, _MULTI_SQL, config=WEIGHTS)
add("join_shared_target", "SELECT ?c ?s ?name WHERE { ?c a tp:Customer ; tp:custnation ?n ; tp:acctbal ?b . ?n tp:nname ?name . ?s a tp:Supplier ; tp:suppnation ?n . FILTER(?b > 9000) }",
    "SELECT c_custkey AS c, s_suppkey AS s, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal > 9000", BOTH)
add("join_pending", """SELECT ?region ?o WHERE { ?r tp:rname ?region . ?o a tp:Orders ; tp:customer ?c ; tp:totalprice ?t . ?n tp:nregion ?r . ?c tp:custnation ?n . FILTER(?t > 300000) }""",
    "SELECT r_name AS region, o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 300000", BOTH, by_weight=False)
add("join_cycle", """SELECT ?line ?c ?s WHERE { ?l a tp:Lineitem ; tp:order ?o ; tp:supplier ?s ; tp:linenumber ?line . ?o tp:customer ?c . ?c tp:custnation ?n . ?s tp:suppnation ?n . ?n tp:nname ?name }""",
    """SELECT l_linenumber AS line, c_custkey AS c, s_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON c_nationkey = n_nationkey WHERE s_nationkey = c_nationkey""", BOTH)  # fmt: skip
add("join_shared_object", 'SELECT ?a ?b WHERE { ?a a tp:Customer ; tp:acctbal ?x ; tp:mktsegment ?seg . ?b a tp:Segment ; tp:segname ?seg . FILTER(?x < 0) }', "SELECT c_custkey AS a, c_mktsegment AS b FROM customer WHERE c_acctbal < 0", BOTH,
    build=lambda spark, d: Engine(spark, mapping_for(d) + turtle_map("Segment", f"{scratch_segments(spark, d)}", "parquet", "seg", {"segname": "seg"})))


def scratch_segments(spark: SparkSession, sf_dir: str) -> str:
    """A small table of the market segments, for a join on a value."""
    path = scratch_folder(spark, "segments")
    spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("seg")).distinct().write.parquet(path)
    return path


# -- groups, order, limits --------------------------------------------------------------------

add("group_count", "SELECT ?s (COUNT(?o) AS ?n) WHERE { ?o a tp:Orders ; tp:orderstatus ?s } GROUP BY ?s", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1", BOTH)
add("group_sum", "SELECT ?p (SUM(?size) AS ?total) WHERE { ?x a tp:Part ; tp:brand ?p ; tp:size ?size } GROUP BY ?p", "SELECT p_brand AS p, sum(p_size)::BIGINT AS total FROM part GROUP BY 1", BOTH)
add("group_avg", "SELECT ?s (ROUND(AVG(?size) * 1000) AS ?mean) WHERE { ?x a tp:Part ; tp:brand ?s ; tp:size ?size } GROUP BY ?s", "SELECT p_brand AS s, round(avg(p_size) * 1000) AS mean FROM part GROUP BY 1")
add("group_min_max", "SELECT ?p (MIN(?t) AS ?low) (MAX(?t) AS ?high) WHERE { ?o a tp:Orders ; tp:orderpriority ?p ; tp:totalprice ?t } GROUP BY ?p", "SELECT o_orderpriority AS p, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1", BOTH)
add("group_distinct", "SELECT ?s (COUNT(DISTINCT ?c) AS ?n) (SUM(DISTINCT ?c) AS ?t) WHERE { ?o a tp:Orders ; tp:orderstatus ?s ; tp:customer ?c } GROUP BY ?s", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n, sum(DISTINCT o_custkey)::BIGINT AS t FROM orders GROUP BY 1")
add("group_all", "SELECT (COUNT(*) AS ?n) (MAX(?q) AS ?top) WHERE { ?l a tp:Lineitem ; tp:quantity ?q }", "SELECT count(*) AS n, max(l_quantity) AS top FROM lineitem")
add("group_concat", 'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=",") AS ?names) WHERE { ?x a tp:Nation ; tp:nname ?n ; tp:nregion ?r } GROUP BY ?r', "SELECT n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
add("having", "SELECT ?c (COUNT(*) AS ?n) WHERE { ?o a tp:Orders ; tp:customer ?c } GROUP BY ?c HAVING (COUNT(*) >= 15 && MIN(?c) > 10)", "SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_custkey > 10 GROUP BY 1 HAVING count(*) >= 15")
add("group_after_join", "SELECT ?nation (COUNT(?o) AS ?n) (MAX(?t) AS ?top) WHERE { ?o a tp:Orders ; tp:customer ?c ; tp:totalprice ?t . ?c tp:custnation ?k . ?k tp:nname ?nation } GROUP BY ?nation",
    "SELECT n_name AS nation, count(*) AS n, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", BOTH)
add("order_multi", "SELECT ?o ?s ?p WHERE { ?o a tp:Orders ; tp:orderstatus ?s ; tp:orderpriority ?p } ORDER BY ?s DESC(?p) ?o LIMIT 500", "SELECT o_orderkey AS o, o_orderstatus AS s, o_orderpriority AS p FROM orders ORDER BY s, p DESC, o LIMIT 500", BOTH)
add("order_multi_all", "SELECT ?o ?s ?p WHERE { ?o a tp:Orders ; tp:orderstatus ?s ; tp:orderpriority ?p } ORDER BY ?s DESC(?p) ?o", "SELECT o_orderkey AS o, o_orderstatus AS s, o_orderpriority AS p FROM orders ORDER BY s, p DESC, o", BOTH)
add("topk_distinct", "SELECT DISTINCT ?n ?b WHERE { ?p a tp:Part ; tp:name ?n ; tp:brand ?b } ORDER BY DESC(?n) ?b LIMIT 40", "SELECT DISTINCT p_name AS n, p_brand AS b FROM part ORDER BY n DESC, b LIMIT 40", BOTH)
add("limit_offset", "SELECT ?c ?b WHERE { ?c a tp:Customer ; tp:acctbal ?b } ORDER BY ?c LIMIT 50 OFFSET 30", "SELECT c_custkey AS c, c_acctbal AS b FROM customer ORDER BY c LIMIT 50 OFFSET 30")
add("order_unselected", "SELECT ?o WHERE { ?o a tp:Orders ; tp:totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 100", "SELECT o_orderkey AS o FROM orders ORDER BY o_totalprice DESC, o LIMIT 100")
add("order_unselected_all", "SELECT ?o WHERE { ?o a tp:Orders ; tp:totalprice ?t } ORDER BY DESC(?t) ?o", "SELECT o_orderkey AS o FROM orders ORDER BY o_totalprice DESC, o")

# -- unions of sources, pattern algebra -------------------------------------------------------

add("union_sources", "SELECT ?party ?n ?b WHERE { ?party a tp:Party ; tp:partyname ?n ; tp:partybal ?b . FILTER(?b > 5000) }",
    "SELECT c_custkey AS party, c_name AS n, c_acctbal AS b FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 5000", BOTH)
add("union_pattern", 'SELECT ?x ?n WHERE { { ?x a tp:Customer ; tp:custname ?n ; tp:mktsegment "MACHINERY" } UNION { ?x a tp:Supplier ; tp:suppname ?n } }', "SELECT c_custkey AS x, c_name AS n FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT s_suppkey, s_name FROM supplier")
add("optional_pattern", "SELECT ?d ?lang ?t WHERE { ?d a tp:Documents ; tp:lang ?lang . OPTIONAL { ?d tp:toxic ?t ; tp:quality ?q . FILTER(?q = 1) } }", "SELECT d.doc_id AS d, lang, toxic AS t FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND quality = 1")
add("optional_filter", "SELECT ?n ?s WHERE { ?n a tp:Nation ; tp:nregion ?r . OPTIONAL { ?s a tp:Supplier ; tp:suppnation ?n ; tp:suppbal ?b . FILTER(?b > 9000 && ?r > 1) } }", "SELECT n_nationkey AS n, s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 AND n_regionkey > 1")
add("minus_pattern", "SELECT ?n ?name WHERE { ?n a tp:Nation ; tp:nname ?name . MINUS { ?s a tp:Supplier ; tp:suppnation ?n ; tp:suppbal ?b . FILTER(?b > 5000) } }", "SELECT n_nationkey AS n, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
add("bind_values", 'SELECT ?c ?twice ?seg WHERE { ?c a tp:Customer ; tp:acctbal ?b ; tp:mktsegment ?seg . VALUES ?seg { "BUILDING" "FURNITURE" } BIND(?b * 2 AS ?twice) FILTER(?twice > 15000) }', "SELECT c_custkey AS c, c_acctbal * 2 AS twice, c_mktsegment AS seg FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_acctbal * 2 > 15000")

# -- transformations --------------------------------------------------------------------------

_NAMED = turtle_map("Named", "{dir}/customer.parquet", "parquet", "c_name", {"ncust": "c_custkey", "nseg": "c_mktsegment"})


def _extra(*maps: str) -> Callable[[SparkSession, str], Engine]:
    return lambda spark, d: Engine(spark, mapping_for(d) + "".join(m.replace("{dir}", d) for m in maps))


def _transform(name: str, clause: str, condition: str, where: str = "TRUE") -> None:
    """orders -> customers by name, the join column transformed on one side or both; ..._all over all orders."""
    add(f"{name}_all", f"SELECT ?o ?k ?seg WHERE {{ ?o a tp:Orders ; tp:customer ?k . ?k a tp:Named ; tp:nseg ?seg }} TRANSFORM({clause})",
        f"SELECT o_orderkey AS o, c_name AS k, c_mktsegment AS seg FROM orders JOIN customer ON {condition} WHERE {where}", BOTH, build=_extra(_NAMED))
    add(name, f"SELECT ?o ?k ?seg WHERE {{ ?o a tp:Orders ; tp:customer ?k ; tp:totalprice ?t . ?k a tp:Named ; tp:nseg ?seg . FILTER(?t > 200000) }} TRANSFORM({clause})",
        f"SELECT o_orderkey AS o, c_name AS k, c_mktsegment AS seg FROM orders JOIN customer ON {condition} WHERE o_totalprice > 200000 AND {where}", BOTH, build=_extra(_NAMED))


_DIGITS = "CAST(replace(c_name, 'Customer#', '') AS BIGINT)"
_transform("transform_replc_toint", '?o?k.r.replc("Customer#","").toInt', f"o_custkey = {_DIGITS}")
_transform("transform_scl_left", '?o?k.l.scl(+7) && ?o?k.r.replc("Customer#","").toInt', f"o_custkey + 7 = {_DIGITS}")
_transform("transform_scl_times", '?o?k.l.scl(*2).scl(-1) && ?o?k.r.replc("Customer#","").toInt', f"o_custkey * 2 - 1 = {_DIGITS}")
_transform("transform_skp", '?o?k.l.skp(5) && ?o?k.r.replc("Customer#","").toInt', f"o_custkey = {_DIGITS}", "o_custkey <> 5")
_transform("transform_substit", '?o?k.l.substit(5,"6") && ?o?k.r.replc("Customer#","").toInt', f"CASE WHEN o_custkey = 5 THEN 6 ELSE o_custkey END = {_DIGITS}")
_transform("transform_prefix", '?o?k.l.prefix("n-") && ?o?k.r.replc("Customer#","").toInt.prefix("n-")', f"o_custkey = {_DIGITS}")
_transform("transform_postfix", '?o?k.l.postfix("-x").postfix("y") && ?o?k.r.replc("Customer#","").toInt.postfix("-xy")', f"o_custkey = {_DIGITS}")
_FNO = """
<#Keyed> rml:logicalSource [ rml:source "{dir}/customer.parquet"; nosql:store nosql:parquet ];
  rr:subjectMap [ rr:template "http://lakeloom.example/keyed/{c_name}"; rr:class tp:Keyed; fnml:functionValue [
      rr:predicateObjectMap [ rr:predicate fno:executes; rr:objectMap [ rr:constant grel:toInt ] ];
      rr:predicateObjectMap [ rr:predicate grel:p; rr:objectMap <#Digits> ] ] ];
  rr:predicateObjectMap [ rr:predicate tp:kseg; rr:objectMap [ rml:reference "c_mktsegment" ] ] .
<#Digits> fnml:functionValue [
      rr:predicateObjectMap [ rr:predicate fno:executes; rr:objectMap [ rr:constant grel:replace ] ];
      rr:predicateObjectMap [ rr:predicate grel:p; rr:objectMap [ rr:reference "c_name" ] ];
      rr:predicateObjectMap [ rr:predicate grel:a; rr:objectMap [ rr:constant "Customer#" ] ];
      rr:predicateObjectMap [ rr:predicate grel:b; rr:objectMap [ rr:constant "" ] ] ] .
"""
add("transform_mapping", "SELECT ?o ?k ?seg WHERE { ?o a tp:Orders ; tp:customer ?k ; tp:totalprice ?t . ?k a tp:Keyed ; tp:kseg ?seg . FILTER(?t > 200000) }",
    "SELECT o_orderkey AS o, o_custkey AS k, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000", build=_extra(_FNO))
add("transform_mapping_all", "SELECT ?o ?k ?seg WHERE { ?o a tp:Orders ; tp:customer ?k . ?k a tp:Keyed ; tp:kseg ?seg }",
    "SELECT o_orderkey AS o, o_custkey AS k, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey", build=_extra(_FNO))

# -- other sources ----------------------------------------------------------------------------


def _csv_engine(spark: SparkSession, sf_dir: str) -> Engine:
    path = scratch_folder(spark, "csv")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").write.option("header", "true").csv(path)
    config = f'# a source of text columns\n{{"sources": [{{"type": "csv", "source": "{path}", "entity": "S", "options": {{"header": "true", "delimiter": ",", "mode": "DROPMALFORMED"}}}}], "weights": []}}'
    return Engine(spark, mapping_for(sf_dir) + turtle_map("TextSupplier", path, "csv", "s_suppkey", {"tname": "s_name", "tnation": "s_nationkey", "tbal": "s_acctbal"}), config)


add("csv_source", "SELECT ?s ?n ?b ?nation WHERE { ?s a tp:TextSupplier ; tp:tname ?n ; tp:tnation ?k ; tp:tbal ?b . ?k tp:nname ?nation . FILTER(?b <= 1000) }",
    "SELECT s_suppkey::VARCHAR AS s, s_name AS n, s_acctbal::VARCHAR AS b, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal <= 1000", BOTH, build=_csv_engine)


def _ntriples_engine(spark: SparkSession, sf_dir: str) -> Engine:
    path, base = scratch_folder(spark, "nt"), "http://lakeloom.example/"
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    subject = F.concat(F.lit(f"<{base}c/"), "c_custkey", F.lit("> "))

    def fact(name: str, value) -> F.Column:
        return F.concat(subject, F.lit(f"<{base}v/{name}> "), value, F.lit(" ."))

    text = lambda column, kind="": F.concat(F.lit('"'), F.col(column).cast("string"), F.lit('"' + (f"^^<http://www.w3.org/2001/XMLSchema#{kind}>" if kind else "")))
    lines = F.array(F.concat(subject, F.lit(f"<http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{base}Client> .")), fact("title", text("c_name")), fact("balance", text("c_acctbal", "double")), fact("nation", text("c_nationkey", "integer")))
    c.select(F.explode(lines).alias("value")).write.text(path)
    config = f'{{"sources": [{{"type": "rdf", "source": "{path}", "options": {{"class": "{base}Client", "shortNames": "true"}}}}]}}'
    return Engine(spark, mapping_for(sf_dir) + turtle_map("Client", path, "rdf", "id", {"ctitle": "title", "cbalance": "balance", "cnation": "nation"}), config)


add("ntriples_table", "SELECT ?c ?t ?b ?nation WHERE { ?c a tp:Client ; tp:ctitle ?t ; tp:cbalance ?b ; tp:cnation ?k . ?k tp:nname ?nation . FILTER(?b > 8000) }",
    "SELECT 'lakeloom.example/c/' || c_custkey AS c, c_name AS t, c_acctbal AS b, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 8000", BOTH, build=_ntriples_engine)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered star over a streamed table, run to the end of what is there."""
    from .streaming import run_available

    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    landing, out = scratch_folder(spark, "landing"), scratch_folder(spark, "stream")
    table.write.parquet(landing)
    schema = ", ".join(f"{n} {t}" for n, t in table.dtypes)
    config = f'{{"sources": [{{"type": "stream", "source": "{landing}", "options": {{"schema": "{schema}"}}}}]}}'
    engine = Engine(spark, PREFIXES + turtle_map("Visit", landing, "stream", "event_id", {"visitor": "user_id", "kind": "event_type", "value": "value"}), config)
    run_available(engine.query(HEAD + 'SELECT ?e ?u ?v WHERE { ?e a tp:Visit ; tp:visitor ?u ; tp:kind "purchase" ; tp:value ?v . FILTER(?v > 50) }').df, out, f"{out}-state")
    return spark.read.schema("e bigint, u bigint, v double").parquet(out)


QUERIES["stream_source"], ORACLES["stream_source"] = _stream, "SELECT event_id AS e, user_id AS u, value AS v FROM events WHERE event_type = 'purchase' AND value > 50"


def _auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, mapping_for(sf_dir)).query(HEAD + "SELECT ?o ?c ?n WHERE { ?o a tp:Orders ; tp:customer ?c . ?c tp:custname ?n }", "auto").df


QUERIES["auto_model"], ORACLES["auto_model"] = _auto, ORACLES["join_fk_id"]


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array attributes pass through as they are; reduced here to what compares across engines."""
    df = Engine(spark, mapping_for(sf_dir)).query(HEAD + "SELECT ?v ?e WHERE { ?v a tp:Embeddings ; tp:embedding ?e ; tp:label ?l . FILTER(?l = 3) }").df
    return df.select("v", F.size("e").cast("long").alias("n"), F.element_at("e", 1).cast("double").alias("first"))


QUERIES["array_passthrough"], ORACLES["array_passthrough"] = _arrays, "SELECT vec_id AS v, len(embedding) AS n, embedding[1]::DOUBLE AS first FROM embeddings WHERE label = 3"


def _graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the property graph by label."""
    found = Engine(spark, mapping_for(sf_dir)).graph(HEAD + "SELECT ?o ?n WHERE { ?o a tp:Orders ; tp:customer ?c . ?c tp:custnation ?n . ?n tp:nname ?x }")
    return found.edges.groupBy(F.element_at(F.split("label", "#"), -1).alias("label")).agg(F.count("*").alias("n_edges"), F.count_distinct("dst").alias("n_targets"))


QUERIES["graph_edges"] = _graph_edges
ORACLES["graph_edges"] = "SELECT 'customer' AS label, count(*) AS n_edges, count(DISTINCT o_custkey) AS n_targets FROM orders UNION ALL SELECT 'custnation', count(*), count(DISTINCT c_nationkey) FROM customer"

__all__ = ["ORACLES", "QUERIES", "TABLES"]
