"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(20)))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` long pairs -> ``(node, component)``: the smallest id reachable, for each linked id.

    Nulls and loops are ignored. Every round is a pair of grouped minima and
    joins, written to the shared folder; rounds grow with the logarithm of
    the graph's size. A hub's links are split by AQE's skew join.
    """
    edges = materialise(
        edges.selectExpr("greatest(u, v) as u", "least(u, v) as v").where("u > v").distinct(), "cc")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.where("v > u").join(least, "u").selectExpr("v as u", "m as v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v > m").selectExpr("v as u", "m as v").union(least.selectExpr("u", "m as v"))
        edges = materialise(small.distinct(), "cc")
        state, before = _state(edges), state
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
