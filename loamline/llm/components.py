"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step replaces links by links to a smaller neighbour and keeps the components; it ends with stars around each
component's smallest id after a number of rounds that grows with the logarithm of the number of nodes. Nothing but two
numbers a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, gathered, settled


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, small: int = BROADCAST_ROWS) -> DataFrame:
    """node, root: every node of links (u, v: long) that isn't its component's smallest, and that smallest node.

    Null ends and links of a node to itself are ignored; repeated links count once; no links give an empty table.
    Tables of at most small rows are worked on in one partition.
    """
    now = settled(links.filter("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen["n"] == 0 or (seen["n"], seen["s"]) == mark:
            return gathered(now, seen["n"], small).select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (seen["n"], seen["s"])
        now = settled(_small_star(_large_star(gathered(now, seen["n"], small))))
