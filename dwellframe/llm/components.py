"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a min-aggregate (combined before its shuffle) and an equi-join
whose two sides are read from stored tables, so Spark can split the partition
of a node with very many links. The table shrinks to stars around the smallest
node of each component; the loop ends when a round leaves it unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _sum(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "star")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every node of ``links`` (columns u, v) that is not the smallest of its component."""
    now = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = _sum(now)
    while seen[0]:
        large = stored(_large_star(now), "links")
        now = stored(_small_star(large), "links")
        if (after := _sum(now)) == seen:
            break
        seen = after
    return now.select("u", F.col("v").alias("root"))
