"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: of every node, the greater neighbours move to its smallest; small star: the smaller neighbours and it do."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches. edges: (u, v) of integers.

    Each round writes its edges to the shared folder and deletes those before. Ends when a round changes nothing; the number of rounds grows with the
    logarithm of the longest path.
    """
    edges = materialize(edges.where("u <> v").distinct(), "edges")
    before = _digest(edges)
    for _ in range(most):
        last, edges = edges, materialize(_star(_star(edges, True), False), "edges")
        discard(last)
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components: no end within the given rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
