"""Connected components of a graph whose edges are rows of long integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airtrace.session import materialise

FILE_EDGES = 500_000


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return int(row.n), int(row.h or 0)


def _smallest(pairs: DataFrame) -> DataFrame:
    """Each (node, other) with the smallest neighbour of the node, itself included."""
    least = pairs.groupBy("a").agg(F.min("b").alias("least"))
    return pairs.join(least, "a").withColumn("least", F.least("least", "a"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for nodes with an edge.

    Large and small stars in turn: neighbours are hung on the smallest node seen,
    until nothing moves. Every round is a few joins on edge rows, written to the
    shared folder; nothing is gathered. A graph has no more edges after a round
    than before, so the number of files follows the count of the round before.
    """
    edges = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = _signature(edges)
    if before[0]:
        for _ in range(rounds):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            large = _smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
            large = large.where("a <> b").distinct()
            down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            hung = _smallest(down)
            small = hung.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
                hung.select("a", F.col("least").alias("b")))
            files = 1 + before[0] // FILE_EDGES
            edges = materialise(small.where("a <> b").distinct().coalesce(files), "stars")
            after = _signature(edges)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
