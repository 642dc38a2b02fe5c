"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trunkwatch.llm.common import stored


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least of node and neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _distinct(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _distinct(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; root is the least node reachable.

    Roots themselves are not listed. Nodes with very many edges only meet
    aggregates and joins that split by rows; each round is written to the shared
    folder. The number of rounds grows with the logarithm of the largest
    component.
    """
    now, was = stored(_distinct(edges.select("a", "b")), "components"), None
    while True:
        now = stored(_small_star(_large_star(now)), "components")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if mark == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = mark
