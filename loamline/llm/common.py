"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a table that may be broadcast; every broadcast is of fewer rows, each of a few dozen bytes.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset a local session gets a new temporary one; a cluster's
    executors would not see that, so there it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="loamline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder, so a lost executor never forces its recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def gathered(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df in one partition where its counted rows stay within the limit: what follows then needs no shuffle at all."""
    return df.coalesce(1) if rows <= limit else df


def lower_az(text: Column) -> Column:
    """Lower-cases A to Z and nothing else (SQL's lower() follows Unicode)."""
    return F.translate(text, UPPER, LOWER)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only where its counted rows stay within the limit; else joins shuffle."""
    return F.broadcast(df) if rows <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not use, whatever its case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
