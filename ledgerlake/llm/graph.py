"""Connected components of a table of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("high").alias("node"), F.col("low").alias("other")).union(
        links.select(F.col("low").alias("node"), F.col("high").alias("other"))
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it instead."""
    around = _both_ways(links)
    least = around.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select("node", F.least("least", "node").alias("least"))
    return around.where("other > node").join(least, "node").select(F.col("other").alias("high"), F.col("least").alias("low"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them instead."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.union(least.select("high", F.col("least").alias("low"))).distinct()


def components(links: DataFrame, purpose: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for every node in `links` (columns high, low; high > low): the smallest node it reaches.

    Links are contracted towards the smallest node until each component is a star; a round is two joins over a table
    that only shrinks, and the number of rounds follows the logarithm of the longest path. Aggregates combine before
    the shuffle and joins may be split, so a node with most of the links fits. An empty table gives an empty table.
    """
    links = stored(links.distinct(), purpose)
    for _ in range(rounds):
        ends = _both_ways(links.select("high", "low")).groupBy("node").agg(
            F.sum((F.col("other") < F.col("node")).cast("long")).alias("up"), F.count("*").alias("n")
        )
        # In a star each node has either one link, upwards, or only links downwards.
        if ends.where("up > 0 and n > 1").isEmpty():
            break
        links = stored(_small_star(_large_star(links)), purpose)
    else:
        raise RuntimeError("components did not converge")
    leaves = links.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return leaves.union(links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
