"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every u hangs on one v, and no v hangs on anything."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(
        edges.select(F.col("v"), F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return seen.where((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))).isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) names.

    The component is the smallest node reachable. Loops and null ends are left out,
    repeated edges count once, no edges give no rows. Edges shrink to stars in a number
    of rounds that grows with the logarithm of the longest path; every round is a
    minimum per node and a join back to it, so a node with many edges is combined
    before the shuffle and split by adaptive joins.
    """
    e = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    while not _is_forest_of_stars(e):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
