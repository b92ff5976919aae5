"""Connected components of an edge list, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return (moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node with links except the smallest of its component, and that smallest node.

    `edges` has the bigint columns u and v, in any direction, with repeats.
    The number of rounds grows with the logarithm of a component's length;
    each writes its edge list to the shared folder.
    """
    stars = scratch_table(edges.select("u", "v").filter("u <> v"), "stars")
    seen = None
    while True:
        stars = scratch_table(_small_star(_large_star(stars)), "stars")
        mark = tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen:
            return stars
        seen = mark
