"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_hot, written


def components(edges: DataFrame) -> DataFrame:
    """node, component for each node of edges (a, b: long): component is the least node that can be reached.

    Each round hangs every node's neighbours on the least of them, first the greater ones, then the others; the rounds end
    when the edges are stars. Their number grows with the logarithm of the longest path. A node's neighbours are only ever
    summed up (a minimum), never collected, hubs are joined by broadcast, and each round is written to the shared folder
    and the one before it deleted. No edges give no rows; repeated edges and loops change nothing.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m"), F.count(F.lit(1)).alias("k")), "least")
        # Large star: a node's greater neighbours go to its least neighbour.
        large = join_hot(both, least, "a", "k", 2 * before[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "large")
        # Small star: a node and its lesser neighbours go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k"))
        small = join_hot(large, low, "a", "k", 2 * before[0]).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        old, edges = edges, written(small, "edges")
        after = _mark(edges)
        forget(old, least, large)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart; the first value is their number."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
