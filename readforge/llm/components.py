"""Connected components of a graph of edges, by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(now: DataFrame) -> tuple[int, bool]:
    """Number of nodes of edges (u, v), and whether these are stars without repeats: each u has one edge, and no v is a u."""
    ends = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.lit(None).cast("bigint").alias("v")))
    nodes = ends.groupBy("u").agg(F.count("v").alias("up"), F.count("*").alias("n"))
    n, more = nodes.agg(F.count("*"), F.max(F.expr("up > 1 or (up = 1 and n > 1)"))).first()
    return n, not more


def components(edges: DataFrame, broadcast_rows: int) -> DataFrame:
    """(node, component) for each node of edges (a, b) but the smallest of a component, which names it.  Any number of rounds until stable.

    Large stars link each larger neighbour to the smallest one, small stars each smaller; minima are aggregates and
    joins, so a node with very many neighbours is split like any skewed join.  Minima of up to `broadcast_rows` nodes are
    broadcast.  Edges are read several times, so they should lie in a table.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while True:
        nodes, settled = _state(now)
        if settled:
            return now.toDF("node", "component")
        minima = F.broadcast if nodes <= broadcast_rows else lambda df: df
        low = now.union(now.select("v", "u")).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = now.join(minima(low), "v").select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        both = F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")
        small = large.join(minima(least), "u").select(both).select("e.u", F.col("e.m").alias("v"))
        now = materialize(small.where("u <> v").distinct(), "edges")
