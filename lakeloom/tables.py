"""The driver's tables as an ontology: a class for each table, a predicate for each column."""

from __future__ import annotations

HEAD = "PREFIX tp: <http://lakeloom.example/tp#>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
PREFIXES = """@prefix tp: <http://lakeloom.example/tp#> .
@prefix rr: <http://www.w3.org/ns/r2rml#>
@prefix rml: <http://semweb.mmlab.be/ns/rml#>
@prefix nosql: <http://purl.org/db/nosql#>
@prefix fnml: <http://semweb.mmlab.be/ns/fnml#>
@prefix fno: <https://w3id.org/function/ontology#>
@prefix grel: <http://users.ugent.be/~bjdmeest/function/grel.ttl#>
"""
# Class: (table, key, predicate -> column).
TABLES: dict[str, tuple[str, str, dict[str, str]]] = {
    "Region": ("region", "r_regionkey", {"rname": "r_name"}),
    "Nation": ("nation", "n_nationkey", {"nname": "n_name", "nregion": "n_regionkey"}),
    "Customer": ("customer", "c_custkey", {"custname": "c_name", "custnation": "c_nationkey", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}),
    "Supplier": ("supplier", "s_suppkey", {"suppname": "s_name", "suppnation": "s_nationkey", "suppbal": "s_acctbal"}),
    "Part": ("part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice"}),
    "Orders": ("orders", "o_orderkey", {"customer": "o_custkey", "orderstatus": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "orderpriority": "o_orderpriority"}),
    "Lineitem": ("lineitem", "l_orderkey", {"order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey", "linenumber": "l_linenumber", "quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnflag": "l_returnflag", "linestatus": "l_linestatus", "shipdate": "l_shipdate"}),
    "Events": ("events", "event_id", {"ts": "ts", "user": "user_id", "eventtype": "event_type", "value": "value", "props": "props"}),
    "Documents": ("documents", "doc_id", {"text": "text", "lang": "lang", "source": "source", "nchars": "n_chars"}),
    "Labels": ("labels", "doc_id", {"quality": "quality", "toxic": "toxic"}),
    "Embeddings": ("embeddings", "vec_id", {"embedding": "embedding", "label": "label"}),
    "Pages": ("pages", "page_id", {"url": "url", "html": "html"}),
    "Conversations": ("conversations", "conv_id", {"turn": "turn", "role": "role", "utterance": "text"}),
}


def turtle_map(cls: str, source: str, store: str, key: str, predicates: dict[str, str], name: str | None = None) -> str:
    body = "".join(f';\n  rr:predicateObjectMap [ rr:predicate tp:{p}; rr:objectMap [ rml:reference "{c}" ] ]' for p, c in predicates.items())
    return f'<#{name or cls}> rml:logicalSource [ rml:source "{source}"; nosql:store nosql:{store} ];\n  rr:subjectMap [ rr:template "http://lakeloom.example/{cls.lower()}/{{{key}}}"; rr:class tp:{cls} ]{body} .\n'


def mapping_for(sf_dir: str) -> str:
    """All tables of a folder; customers and suppliers are parties too."""
    maps = [turtle_map(c, f"{sf_dir}/{t}.parquet", "parquet", k, p) for c, (t, k, p) in TABLES.items()]
    maps.append(turtle_map("Party", f"{sf_dir}/customer.parquet", "parquet", "c_custkey", {"partyname": "c_name", "partybal": "c_acctbal"}, "PartyC"))
    maps.append(turtle_map("Party", f"{sf_dir}/supplier.parquet", "parquet", "s_suppkey", {"partyname": "s_name", "partybal": "s_acctbal"}, "PartyS"))
    return PREFIXES + "".join(maps)
