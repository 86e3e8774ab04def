"""Connected components of an edge table, by alternating large-star and small-star.

The two-phase contraction of Kiveris et al. (2014): every round points nodes at
the least node they can see, so the edges turn into stars around the least node
of each component. A hub's edges are never gathered: its least neighbour is a
``min`` aggregate, joined back, and adaptive execution can split that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of ``a, b`` edges (a > b)."""
    flipped = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    seen = down.unionByName(flipped) if large else down
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = seen.join(least, "u")
    if large:
        moved = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter(F.col("a") > F.col("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h % 1_000_003)).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the least node it reaches) for every node on an edge.

    Self-loops and edges with a NULL end are ignored; repeated edges count once.
    Nodes without an edge are not returned. Ends once a round changes nothing.
    """
    edges = stored(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = stored(_star(_star(edges, large=True), large=False), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(
        stars.select(F.col("component").alias("node"), "component").distinct())
