"""Distributed union-find: connected components by alternating stars.

Each round hangs every vertex's larger neighbours on its smallest one (large
star) and then its smaller neighbours (small star); edges shrink to one star a
component in a number of rounds that grows with the logarithm of its diameter.
Every round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stash


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Columns u, v (long) in, links in either direction; out (id, component) for every
    vertex that isn't the smallest of its component, which is the component's name."""
    flat = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stash(flat, "cc")
    before = _mark(now)
    for _ in range(most_rounds if before[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stash(small, "cc")
        after = _mark(new)
        forget(now)
        now = new
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components aren't done after {most_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
