"""Connected components of a distributed edge list, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.session import stored

MAX_ROUNDS = 60


def components(edges: DataFrame, *group: str) -> DataFrame:
    """For each vertex of ``edges`` (a, b; longs) the smallest vertex it is connected with, per group.

    Every round links all neighbours of a vertex to the smallest of them, first the larger
    ones, then the smaller; the number of rounds grows with the logarithm of the longest
    chain. Rounds are stored in the shared folder, so a lost executor repeats one round.
    Returns the group columns, ``v`` and ``root``; vertices without an edge are not listed.
    """
    keys = list(group)
    edges = stored(_down(edges, keys), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        edges = stored(_small(_large(edges, keys), keys), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = edges.select(*keys, F.col("b").alias("v")).distinct().withColumn("root", F.col("v"))
    return edges.select(*keys, F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots)


def _down(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each edge once, from the larger end ``a`` to the smaller ``b``."""
    return edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Links the larger neighbours of each vertex to the smallest vertex around it."""
    both = edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(*keys, "b", "a"))
    least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where("v > u").join(least, [*keys, "u"])
    return larger.select(*keys, F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Links the smaller neighbours of each vertex, and itself, to the smallest of them."""
    least = edges.groupBy(*keys, "a").agg(F.min("b").alias("m"))
    joined = edges.join(least, [*keys, "a"])
    return _down(joined.select(*keys, "b", F.col("m").alias("x")).toDF(*keys, "a", "b")
                 .union(least.select(*keys, "a", F.col("m").alias("b"))), keys)
