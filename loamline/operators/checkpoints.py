"""Tables that later steps read more than once, written to the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast, each of a few dozen bytes.
FEW = 100_000


def ensure_checkpoints(spark: SparkSession) -> None:
    """The folder of spark.checkpoint.dir. Where the session names none a local one gets a temporary folder; on a cluster
    that is an error, as executors would not see it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loamline-"))


def stored(df: DataFrame) -> DataFrame:
    """df written once, so that neither later steps nor a lost executor compute it again."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def stored_few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """df written once, and marked for broadcast where its counted rows stay within the limit; else joins shuffle."""
    held = stored(df)
    return F.broadcast(held) if held.count() <= limit else held


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df, a table as it is read, over all cores where its rows are in fewer parts than these, or the largest part holds more
    than twice a core's share. Parts without rows don't count: a row group is in one part, however many its file is cut into."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))  # from the files' footers
    n, rows, most = parts.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    uneven = n and (n < cores or most * cores > 2 * rows)
    return df.repartition(max(cores, df.rdd.getNumPartitions()), *keys) if uneven else df
