"""Connected components of a graph given as links, by alternating large and small stars.

Kiveris and others, "Connected Components in MapReduce and Beyond" (2014): every round hangs the
neighbours of a node on the smallest node known to it, until only stars are left. A round is a minimum
per node, which Spark sums up before the shuffle, and a join back to the links. The side with the
minima is settled first, so the join reads two plain exchanges and a node with very many links is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import settled


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame, size: int) -> DataFrame:
    """Larger neighbours of a node go to the smallest of its neighbourhood."""
    near = _both_ways(links)
    low = settled(near.groupBy("u").agg(F.least("u", F.min("v")).alias("low")), 2 * size)
    return (
        near.where("v > u")
        .join(low, "u")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .distinct()
    )


def _small_star(links: DataFrame, size: int) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of these. Links point downwards: u > v."""
    low = settled(links.groupBy("u").agg(F.min("v").alias("low")), size)
    moved = links.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node with a link to another; ``root`` is the smallest node it can reach.

    Repeated links and links of a node to itself change nothing; links with a NULL end are ignored.
    """
    stars = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    stars = settled(stars)
    before = _state(stars)
    while before[0]:
        size = before[0]
        stars = settled(_small_star(settled(_large_star(stars, size), size), size), size)
        now = _state(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
