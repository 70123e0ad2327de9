"""Connected components of a graph given as a DataFrame of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.shared import materialize


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of ``edges`` (``a``, ``b``) but the roots.

    Each round hooks neighbours to the smallest one they know; edges are written to
    the shared folder between rounds, and the driver sees only a count and a
    checksum. Self-loops, repeated and null edges are ignored. Hubs meet as keys of
    joins, which adaptive execution splits; minima are pre-aggregated.
    """
    clean = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = materialize(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _checksum(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(roots, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(roots)
        now = materialize(small.distinct(), "edges")
        before, seen = seen, _checksum(now)
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if seen[0]:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
