"""Connected components of an edge table by alternating large and small stars.

Both steps replace a node's edges by edges to its least neighbour.  A node's least neighbour comes from an aggregate,
which combines before the shuffle, and goes back to its edges in a join, which can split a hub's edges over tasks.
Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import removed, scratch, stored


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    """Two sums over the edges' hashes, which differ if the edges do (up to a chance of 2**-64 or so)."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 20))).first())


def components(edges: DataFrame) -> DataFrame:
    """Node and root (its component's least node) for every node of edges (u, v: longs) but the roots themselves."""
    spark, path = edges.sparkSession, scratch(edges.sparkSession)
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), path)
    before = None
    while (now := _state(edges)) != before and now[0]:
        before, last, path = now, path, scratch(spark)
        edges = stored(_small(_large(edges)).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), path)
        removed(spark, last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
