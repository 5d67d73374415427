"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import dropped, looked_up, staged


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m, degree): the least neighbour of each node, or the node itself."""
    return staged(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree")), "least")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the least node reachable.

    Each round, nodes link their larger neighbours to their least neighbour and then their
    smaller ones, until all edges lead to a component's least node: every round leaves fewer edges or
    lower ends, so that it comes to that. A hub's edges stay single rows: only minima are aggregated, and
    they are looked up, those of hubs by broadcast. Rows with a null end, loops and repeated edges
    are allowed.
    """
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).dropna().filter("u <> v").distinct()
    pairs = staged(pairs, "edges")
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = looked_up(both, least, ["u"], "degree").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u <> v").distinct(), "edges")
        dropped(least)
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = _least(small)
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        after = staged(looked_up(small, least, ["u"], "degree").select(F.explode(ends).alias("e")).select("e.*").filter("u <> v").distinct(), "edges")
        dropped(pairs, large, least)
        pairs = after
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())
