"""The graph model: stars are vertices, foreign keys are edges, a pattern is a motif of triplets.

A vertex id is (star, key), so ids of different stars never meet. Vertices keep typed
attributes in a struct. An edge carries its source vertex, so a triplet view takes one join,
and vertices need no unique key.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stars import GroupPlan, JoinEdge

PRIVATE = "__v_"


class PropertyGraph(NamedTuple):
    """vertices(id, attributes) and edges(src, dst, label), attributes as text."""

    vertices: DataFrame
    edges: DataFrame


def vertex_id(star: str, key: Column) -> Column:
    """Null where the key is null: a struct of nulls would equal another one."""
    return F.when(key.isNotNull(), F.struct(F.lit(star).alias("star"), key.cast("string").alias("key")))


def vertices_of(star: str, table: DataFrame) -> DataFrame:
    """(id, v): a star's rows as vertices; without a key variable the id is null."""
    key = vertex_id(star, F.col(f"`{star}`")) if star in table.columns else F.lit(None).cast("struct<star:string,key:string>")
    return table.select(key.alias("id"), F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("v"))


def edges_of(edge: JoinEdge, vertices: DataFrame) -> DataFrame:
    """(src, dst, label, v): the edges of a foreign key, each with its source's attributes."""
    to = vertex_id(edge.right, F.col(f"v.`{edge.variable}`"))
    return vertices.select(F.col("id").alias("src"), to.alias("dst"), F.lit(edge.predicate).alias("label"), "v").filter("dst is not null")


def triplets(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, src_v, label, dst, dst_v)."""
    return edges.select("src", "dst", "label", F.col("v").alias("src_v")).join(targets.select(F.col("id").alias("dst"), F.col("v").alias("dst_v")), "dst")


def property_graph(plan: GroupPlan, tables: dict[str, DataFrame]) -> PropertyGraph:
    vertices = {n: vertices_of(n, t) for n, t in tables.items()}
    as_text = [v.select("id", F.map_from_arrays(F.array(*[F.lit(c) for c in tables[n].columns]), F.array(*[F.col(f"v.`{c}`").cast("string") for c in tables[n].columns])).alias("attributes")) for n, v in vertices.items()]
    edges = [edges_of(e, vertices[e.left]).select("src", "dst", "label") for e in plan.edges if e.predicate]
    empty = as_text[0].select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("").alias("label")).limit(0)
    return PropertyGraph(reduce(DataFrame.unionByName, as_text), reduce(DataFrame.unionByName, edges, empty))


def match_motif(plan: GroupPlan, tables: dict[str, DataFrame]) -> DataFrame:
    """The bindings of the motif that the plan's stars and edges make."""
    vertices = {n: vertices_of(n, t) for n, t in tables.items()}
    col = lambda star, what: F.col(f"`{PRIVATE}{star}`.{what}")

    def packed(star: str) -> DataFrame:
        return vertices[star].select(F.struct("id", "v").alias(PRIVATE + star))

    def condition(e: JoinEdge, left: DataFrame, right: DataFrame) -> Column:
        """That an edge holds between stars that are both at hand."""
        if e.predicate:
            return vertex_id(e.right, col(e.left, f"v.`{e.variable}`")) == col(e.right, "id")
        x, y = tables[e.left], tables[e.right]
        kinds = x.schema[e.variable].dataType, y.schema[e.variable].dataType
        if kinds[0] == kinds[1]:
            return col(e.left, f"v.`{e.variable}`") == col(e.right, f"v.`{e.variable}`")
        return col(e.left, f"v.`{e.variable}`").cast("string") == col(e.right, f"v.`{e.variable}`").cast("string")

    first, *rest = plan.stars
    out, done = packed(first.star.name), {first.star.name}
    for p in rest:
        name = p.star.name
        own = plan.edge_between(done, name)
        conditions = [condition(e, out, tables[name]) for e in own]
        out = out.join(packed(name), reduce(lambda a, b: a & b, conditions)) if conditions else out.crossJoin(packed(name))
        done.add(name)
    # A variable's value comes from the star that it identifies, else from the first that has it.
    names = dict.fromkeys(c for n in done for c in tables[n].columns if c != "__one")
    order = [p.star.name for p in plan.stars]

    def home(variable: str) -> str:
        bare = variable.removeprefix("__raw_").removeprefix("__iri_")
        return bare if bare in tables and variable in tables[bare].columns else next(n for n in order if variable in tables[n].columns)

    found = [col(home(v), f"v.`{v}`").alias(v) for v in names]
    return out.select(*found) if found else out.select(F.lit(1).alias("__one"))

