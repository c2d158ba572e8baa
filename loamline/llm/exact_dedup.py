"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each round keeps only rows whose cheap key is shared; the next, dearer key is computed for these alone. Survivors
of a round are remembered as a bitmap-like table of at most BUCKETS key buckets, a fixed broadcast bound: a row that
shares a bucket by chance is hashed in vain, never merged wrongly. Groups are made of full SHA-256 hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, settled, whole_text

#: Buckets of surviving keys; the broadcast table never has more rows than this.
BUCKETS = 1 << 20
PREFIX_CHARS = 64
#: A group with more than one in so many of all rows is hot; there are fewer hot groups than this.
HOT_SHARE = 1000


def _survivors(keyed: DataFrame) -> DataFrame:
    """Buckets of those keys that at least two rows have. keyed: a column key (binary or long) for each row."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return shared.select(_bucket(F.col("key")).alias("bucket")).distinct()


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, and the columns of carry.

    Texts are equal when identical after lower-casing A to Z. Of equal texts the row with the largest id is kept.
    carry: more columns, computed from id_col and text_col in the last scan.
    Null text counts as empty. A null id ranks below any other; a group of null ids alone keeps keep_id null. Rows
    that repeat an id and a text share a keep_id, and all rows with that id are marked kept (they are one document).
    An empty table gives an empty result. Other columns of docs are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), whole_text(F.col(f"`{text_col}`")).alias("text"))
    length = F.octet_length("text").cast("long")
    # the hash of the lower-cased first characters, which lie within the text's own memory: the rest isn't touched
    prefix = F.xxhash64(length, lower_az(F.substring("text", 1, prefix_chars)))
    by_length = _survivors(rows.select(length.alias("key")))
    in_length = rows.join(F.broadcast(by_length), _bucket(length) == F.col("bucket"), "left_semi")
    by_prefix = _survivors(in_length.select(prefix.alias("key"))).withColumn("shared", F.lit(True))
    full = F.when(F.col("shared"), F.unhex(F.sha2(lower_az(F.col("text")), 256)))
    scanned = rows.join(F.broadcast(by_prefix), _bucket(prefix) == F.col("bucket"), "left")
    narrow = settled(scanned.select(F.col(id_col), full.alias("full"), *[c.alias(k) for k, c in (carry or {}).items()]))

    groups = settled(narrow.filter("full IS NOT NULL").groupBy("full").agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"))
    hot_above = narrow.count() // HOT_SHARE
    hot = groups.filter(F.col("group_size") > hot_above).select(F.col("full").alias("hot_full"), F.col("keep_id").alias("hot_keep"), F.col("group_size").alias("hot_size"))
    cold = groups.filter(F.col("group_size") <= hot_above).withColumnRenamed("full", "cold_full")
    # hot rows meet a broadcast of fewer than HOT_SHARE groups; in the shuffle of the rest they are dealt by their id
    met = narrow.join(F.broadcast(hot), F.col("full") == F.col("hot_full"), "left")
    spread = F.when(F.col("hot_full").isNotNull() | F.col("full").isNull(), F.unhex(F.lpad(F.hex(F.xxhash64(id_col)), 16, "0"))).otherwise(F.col("full"))
    met = met.withColumn("join_full", spread).join(cold, F.col("join_full") == F.col("cold_full"), "left")
    grouped = F.coalesce("hot_size", "group_size")
    return met.select(
        F.col(id_col),
        F.when(grouped.isNull(), F.col(id_col)).otherwise(F.coalesce("hot_keep", "keep_id")).alias("keep_id"),
        F.coalesce(grouped, F.lit(1)).cast("long").alias("group_size"),
        *carry or {},
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def normalised_sha256(text: Column) -> Column:
    return F.sha2(lower_az(whole_text(text)), 256)
