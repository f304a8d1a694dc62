"""Connected components by alternating large-star and small-star steps; edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) of long ids -> (node, component): the smallest id reachable, for every id that has an edge.

    Each step keeps at most one row per edge, and its minimum per node is aggregated before the
    shuffle, so a node with very many edges costs no task more than its share (its join is one
    that AQE splits). The number of steps grows with the logarithm of the longest path. The result reads
    scratch's table "star"; write it before that is dropped.
    """

    def step(edges: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges, written and read again, and a fingerprint observed while they are written."""
        seen = Observation()
        marks = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("x"), F.sum(F.xxhash64("b", "a") % 999_983).alias("y")]
        now = scratch.put(edges.observe(seen, *marks), "star")
        return now, tuple(sorted(seen.get.items()))

    now, mark = step(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while before != mark:
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now, mark = step(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
