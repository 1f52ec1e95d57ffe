"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, look_up_spread, written


def _stars(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """One star step over at most ``most`` edges (a, b) with a > b: a node's neighbours move to the least of them.

    The least neighbour is found by partial aggregation. It goes back to the neighbours of
    a hub by broadcast (hubs are few, their number is bounded) and to all others by a join.
    """
    at = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        at = at.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = at.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    moved = look_up_spread(at, least, ["u"], "n", 2 * most).filter("v > u" if large else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return written(moved.filter("a <> b").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node) for all nodes of ``edges`` (a, b).

    Each step is written, so a lost executor costs one step. It ends when a round changes
    nothing; the number of rounds grows with the logarithm of the longest path.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        # Counted first: what a round has read is removed after it.
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if new == mark or not new[0]:
            break
        half = _stars(now, True, new[0])
        mark, before, now = new, now, _stars(half, False, new[0])
        discard(before, half)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
