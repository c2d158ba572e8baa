"""Running totals within groups of any size: blocks of a group are summed first, so no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbouring values of an integer order that share a block.
BLOCK = 4096


def running_total(rows: DataFrame, keys: list[str], order: str, weight: Column, name: str) -> DataFrame:
    """rows with name: the sum of weight over the rows of equal keys with a smaller order (an integer, unique in them).

    Rows move once, to the block they are in; the window over a group sees a row for each block, BLOCK times fewer.
    Null keys are equal to each other, a null order comes first, a null weight counts as 0.
    """
    block = F.floor(F.col(order) / BLOCK)
    weight = F.coalesce(weight.cast("long"), F.lit(0))
    parted = rows.withColumn("lm_part", F.struct(*keys, block.alias("lm_block")))
    earlier = Window.partitionBy(*[F.col(f"lm_part.{k}") for k in keys]).orderBy("lm_part.lm_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy("lm_part").agg(F.sum(weight).alias("lm_total"))
    before = totals.select("lm_part", F.coalesce(F.sum("lm_total").over(earlier), F.lit(0)).alias("lm_before"))
    inside = Window.partitionBy("lm_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = parted.withColumn(name, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return summed.join(before, "lm_part").withColumn(name, F.col(name) + F.col("lm_before")).drop("lm_part", "lm_before")
