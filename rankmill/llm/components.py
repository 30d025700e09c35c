"""Connected components by alternating large-star and small-star.

Each round is two aggregations and joins on node ids; minima are combined
before the shuffle, so a node with very many neighbours sends one row per map
task, and the join back is split by adaptive execution.  Edges stay in tables:
nothing is gathered on the driver but the number of edges and their checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.session import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over ``edges(u, v)`` with u > v; gives edges of the same form."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` of every node in ``pairs(a, b)``; a component is named by its least node.

    NULL ends and pairs of a node with itself are ignored; no pairs, no rows.
    """
    edges = scratch.write(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        new = scratch.write(_star(_star(edges, True), False))
        mark = new.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        scratch.drop(edges)
        edges = new
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
