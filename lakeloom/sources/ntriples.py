"""N-Triples as a type table: one row for each subject of a class, one column for each property.

A subject's type is the lexicographically last of its rdf:types; its other types become columns
type_X with the text 1. A property's column is a scalar if no subject of the class has more than
one value for it, else an array; its datatype is double, int, boolean, timestamp or string (an
array: double, int or string). Subjects without the property have null. `id` is the subject.
Lines that are no triple are skipped. Only the list of properties comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sparql.ast import RDF_TYPE, XSD

_NODE = r"(<[^>]*>|_:\S+)"
_LINE = rf"^\s*{_NODE}\s+<([^>]*)>\s+(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\")(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?\s*\.\s*(?:#.*)?$"


def triples(spark: SparkSession, source: str) -> DataFrame:
    """(s, p, o, datatype, lang) of every line; IRIs without <> and http://."""
    part = lambda i: F.regexp_extract("value", _LINE, i)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^<|>$", ""), r"^http://", "")
    raw = part(3)
    text = F.regexp_replace(F.regexp_replace(raw, r'^"|"$', ""), r"\\([\"\\])", "$1")
    text = F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\r"), F.lit("\r"))
    rows = spark.read.text(source).filter(F.col("value").rlike(_LINE))
    return rows.select(bare(part(1)).alias("s"), part(2).alias("p"), F.when(raw.startswith('"'), text).otherwise(bare(raw)).alias("o"), part(4).alias("datatype"), part(5).alias("lang"))


def _kind(datatype: Column) -> Column:
    tail = F.when(datatype.startswith(XSD), F.substring(datatype, len(XSD) + 1, 100)).otherwise(F.lit(""))
    return F.when(tail == "double", "double").when(tail.startswith("int"), "int").when(tail == "boolean", "boolean").when(tail == "dateTime", "timestamp").otherwise("string")


def read_ntriples(spark: SparkSession, source: str, options: dict[str, str] | None = None) -> DataFrame:
    """Options: class (IRI, needed), shortNames (true: columns are local names)."""
    options = options or {}
    wanted = options.get("class", "").strip("<>").removeprefix("http://")
    if not wanted:
        raise ValueError("an N-Triples source needs the option class")
    facts = triples(spark, source)
    kinds = facts.filter(F.col("p") == RDF_TYPE).groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("types"))
    kinds = kinds.filter(F.element_at("types", -1) == wanted)
    own = facts.filter(F.col("p") != RDF_TYPE).join(kinds.select("s"), "s", "left_semi").withColumn("kind", _kind(F.col("datatype")))
    per_subject = own.groupBy("s", "p", "kind").agg(F.count("*").alias("n")).groupBy("s", "p").agg(F.sum("n").alias("n"), F.collect_set("kind").alias("kinds"))
    found = per_subject.groupBy("p").agg(F.max("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds")).orderBy("p").collect()
    others = [r["t"] for r in kinds.select(F.explode(F.slice("types", 1, F.size("types") - 1)).alias("t")).distinct().orderBy("t").collect()]
    short = options.get("shortNames", "").lower() == "true"

    def name(iri: str) -> str:
        return iri.replace("#", "/").rsplit("/", 1)[-1] if short else iri.removeprefix("http://")

    columns = []
    for r in found:
        mine = F.when(F.col("p") == r["p"], F.col("o"))
        kind = r["kinds"][0] if len(r["kinds"]) == 1 else "string"
        if r["n"] == 1:
            value = F.max(mine)
            columns.append((value if kind == "string" else value.try_cast(kind)).alias(name(r["p"])))
        else:
            value = F.array_sort(F.collect_list(mine))
            inner = kind if kind in ("double", "int") else "string"
            columns.append(F.when(F.size(value) > 0, value.try_cast(f"array<{inner}>")).alias(name(r["p"])))
    table = own.groupBy("s").agg(*columns) if columns else own.select("s").distinct()
    typed = kinds.join(table, "s", "left")
    marks = [F.when(F.array_contains("types", t), F.lit("1")).alias(f"type_{name(t)}") for t in others]
    return typed.select(F.col("s").alias("id"), *[F.col(f"`{c}`") for c in table.columns if c != "s"], *marks)
