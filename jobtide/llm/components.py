"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame) -> DataFrame:
    """(a, b) beside ``low``, the least of a and its neighbours. A hub's rows are split by the join, its minimum is taken map-side."""
    low = pairs.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("low"))
    return pairs.join(low, "a")


def _round(edges: DataFrame) -> DataFrame:
    large = _star(_both(edges)).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    starred = _star(down)
    return starred.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(starred.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge (a, b) of longs.

    Each round is written to the shared folder; the driver sees two numbers of
    it. Rounds grow with the logarithm of the size. Loops and repeated edges are
    ignored; no edges give no rows.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == seen or state[0] == 0:
            break
        seen, now = state, materialize(_round(now), "edges")
    # At rest every edge leads from a node to the least node of its component.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
