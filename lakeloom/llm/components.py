"""Connected components of a graph given as a DataFrame of edges.

Alternates two contractions until nothing changes: every node hands its larger
neighbours to its least one, then its smaller neighbours too. The edges end as
stars around the least node of each component. A step is an aggregation and an
equi-join on a node, so a node with very many neighbours is split by skew-join
handling and its neighbours are never gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _pairs(df: DataFrame) -> DataFrame:
    """Each edge once, as (u, v) with u > v."""
    u, v = F.greatest("u", "v"), F.least("u", "v")
    return df.select(u.alias("u"), v.alias("v")).filter("u > v").distinct()


def _contract(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = _pairs(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return _pairs(small)


def _print(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is its least node.

    Null ends and loops are no edges. An empty table gives an empty result.
    """
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    now = stored(_pairs(clean), "edges")
    seen = _print(now)
    while seen[0]:
        last, now = now, stored(_contract(now), "edges")
        before, seen = seen, _print(now)
        discard(last)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
