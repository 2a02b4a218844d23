"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed

#: Edges of a partition: rounds over few edges would write thousands of files with next to nothing in them.
EDGES_A_PART = 50_000


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).coalesce(parts).distinct().coalesce(parts)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (columns a, b) from each linked node.

    Each round hangs every node on the smallest of its neighbourhood, so the number
    of rounds follows the logarithm of the longest path.  Rounds are checkpointed in
    the shared folder; only their edge count and a checksum come to the driver.
    Loops and null ends are ignored; nodes without links are absent.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, seen = checkpointed(edges.distinct()), None
    while True:
        # sums of 31-bit halves of a hash: independent of order, far from overflow
        check = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.shiftrightunsigned(F.xxhash64("a", "b"), 33)).alias("hi"),
            F.sum(F.xxhash64("b", "a").bitwiseAND(0x7FFFFFFF)).alias("lo"),
        ).first()
        if check["n"] == 0 or (check["n"], check["hi"], check["lo"]) == seen:
            break
        seen = (check["n"], check["hi"], check["lo"])
        parts = -(-check["n"] // EDGES_A_PART)  # a round adds no edges
        edges = checkpointed(_small_star(_large_star(edges.coalesce(parts), parts), parts))
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
