"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is two hash aggregations with map-side combine and one join, so a hub with very many neighbours is
pre-aggregated on the map side and its join partition is split by adaptive execution. Edges go to the shared folder
after each round; nothing but one row of counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import park, unpark


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each larger neighbour is tied to the node's minimum. Small: each smaller-or-equal one is."""
    if large:
        pairs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = pairs.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        tied = pairs.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = tied.unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) -> (node, component) for every node that has an edge to another; component is the smallest node."""
    edges = park(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        last = edges
        edges = park(_star(_star(edges, large=True), large=False), "edges")
        unpark(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
    raise RuntimeError("components did not settle")
