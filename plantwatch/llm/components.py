"""Connected components of an edge list, for groups of near-equal texts or lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantwatch.session import stored


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the
    edges are stars around the roots. A step is one aggregation for the smallest
    neighbour and one join, so a hub's neighbours are never gathered in one
    place; every round is written to the shared folder. No edges: no rows.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = stored(edges.where(F.col("a") != F.col("b")).select(u, v).distinct(), purpose)
    mark = None
    while True:
        both = now.union(now.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("_m")).select("x", F.least("x", "_m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(least.select("u", "m")).distinct(), purpose)
        last, mark = mark, tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == last or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v").distinct())
