"""Connected components of a links table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node in ``links(a, b)``; the component is its least node.

    Each round lets every node hang its larger neighbours on its least one, then
    its smaller ones, until nothing moves; rounds grow with the logarithm of the
    longest chain. Every round is written to the shared folder and the one before
    it deleted. It ends when nothing is left to move: every round that changes
    something lowers the sum of the nodes' least neighbours.
    """
    edges = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        # done when no node hangs on two, and none that others hang on hangs itself
        hung = edges.groupBy("b").agg(F.count("*").alias("n"))
        if not hung.filter("n > 1").select("b").union(edges.select("a").distinct().join(hung, F.col("a") == F.col("b"), "left_semi")).take(1):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a"), F.col("a")).distinct())
        both = edges.union(edges.select("b", "a"))
        # Written first, so that the join is one of its own and a node of many links can be split.
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "links-least")
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # now every edge points from a smaller node a to a larger b: hang all of b's on the least
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_least, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        before, edges = edges, stored(small.filter("a <> b").distinct(), "links")
        drop_stored(before, least)
