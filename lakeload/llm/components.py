"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import stored


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with an edge to another one; root is the smallest node.

    Every round hangs the neighbours of a node on the smallest of them, first
    the larger ones, then all. Edges stay at most as many as at the start, the
    number of rounds grows with the logarithm of the longest chain, and every
    round is written to the shared folder, which cuts the lineage. Minima are
    merged before the shuffle, so a node with many neighbours is no hot spot.
    """
    pairs = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    current = stored(pairs.where(F.col("a") != F.col("b")).distinct(), "edges")
    mark = _mark(current)
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(lowest, "u")
        large = large.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        small = (
            small.select("a", F.col("m").alias("b"))
            .unionByName(small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        current = stored(small, "edges")
        before, mark = mark, _mark(current)
        if mark == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))
    ).first()
    return tuple(row)
