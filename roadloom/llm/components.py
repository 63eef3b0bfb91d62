"""Connected components of an edge table by alternating large-star and small-star contraction.

Each round is two group-and-join steps on the edges, which stay distributed; the lineage is cut by
writing the edges to the shared folder. A node with many edges is handled by a partial minimum and a
join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:  # every larger neighbour of u goes to the smallest of u and its neighbours
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select("m", "v").union(least.select("m", F.col("u")))
    return moved.where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node with an edge (a, b)."""
    edges = edges.select("a", "b").where("a <> b").distinct()
    before = None
    while True:
        edges = stage(_star(_star(edges, True), False), "stars")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
