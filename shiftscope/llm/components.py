"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component)``: the smallest id reachable, for every id on an edge.

    Each step groups by node with a map-side minimum and joins the minimum back, so a node
    with very many links is combined before the shuffle and its join can be split.  The number
    of steps grows with the logarithm of the longest path.  Self links and NULLs are ignored."""
    cur = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .distinct(), "edges")
    seen = None
    while True:
        # large star: the larger neighbours of a node are linked to its smallest neighbour
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        # small star: the smaller neighbours and the node itself are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        cur = stash(small, "star")
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
