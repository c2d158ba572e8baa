"""Resampling towards a target's distribution by hashed n-gram importance weights.

One scan of a document keeps a ring of running CRC-32 states, one for each of the last n places where a word began;
each new word, with a space before it, extends all of them, and every state is then the hash of a whole run of words. So
no run is ever put together. The buckets of both corpora are counted in arrays of a fixed size, a document's weight is the
mean gain of its buckets, and Gumbel noise from a hash of its id turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled
from .tokens import bounded_batches

BUCKETS, NGRAMS, PERCENT, MIN_WORDS, SEED, SCALE = 10_000, 1, 10, 20, 2024, 1000


def _letters() -> bytes:
    """What each byte of a text counts as: letters in lower case, digits and bytes beyond ASCII as they are, others a space."""
    return bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


_LETTERS = _letters()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def ring_hashes(words: list[bytes], n: int) -> Iterator[int]:
    """The CRC-32 of every run of 1 to n words joined by single spaces."""
    if n == 1:  # no start but the word's own is kept
        yield from map(crc32, words)
        return
    ring: deque[int] = deque(maxlen=n)
    for word in words:
        spaced = b" " + word
        ring = deque((crc32(spaced, state) for state in list(ring)[-(n - 1) :]), maxlen=n)
        ring.append(crc32(word))
        yield from ring


def feature_buckets(docs: DataFrame, id_col: str | None, text_col: str, n: int, buckets: int) -> DataFrame:
    """A row for each row: id (if there is an id_col), n_words, n_features and buckets, the features' buckets as
    little-endian integers of 2 bytes, or of 4 beyond 65,536 buckets."""
    bounded_batches(docs.sparkSession)
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    ids = [F.col(f"`{id_col}`").alias("id")] if id_col else []
    schema = (f"id {docs.schema[id_col].dataType.simpleString()}, " if id_col else "") + "n_words long, n_features long, buckets binary"

    def run(batches):
        for b in batches:
            counts, features, out = [], [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                words = words_of(text or b"")
                hashed = np.fromiter(ring_hashes(words, n), np.uint32)
                counts.append(len(words)), features.append(len(hashed)), out.append((hashed % buckets).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64()), pa.array(features, pa.int64()), pa.array(out, pa.binary())], [*b.schema.names[:-1], "n_words", "n_features", "buckets"])

    return docs.select(*ids, F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, schema)


def _numbers(column: pa.ChunkedArray | pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has. A task sends a row for each of its buckets; the driver holds one array of them."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(_numbers(b.column(0), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    counted = features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # buckets rows at most
    out = np.zeros(buckets, np.int64)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The scaled log ratio of each bucket's smoothed share in the target and in the raw corpus, rounded down."""
    size, s, t = float(len(raw)), float(raw.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((float(b) + 1) * (s + size) / ((float(a) + 1) * (t + size)))) for a, b in zip(raw, target, strict=True)], np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """features without buckets, but with weight: the mean gain of a row's features, rounded down; 0 without any."""
    kind = np.dtype("<u2" if len(gain) <= 1 << 16 else "<u4")
    names = [c for c in features.columns if c != "buckets"]

    def run(batches):
        for b in batches:
            n = b.column("n_features").to_numpy()
            ends = np.cumsum(n)
            total = np.concatenate([[0], np.cumsum(gain[_numbers(b.column("buckets"), kind)])])
            weight = (total[ends] - total[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(weight, pa.int64())], [*names, "weight"])

    return features.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in features.dtypes if c != "buckets") + ", weight long")


def noise(id_column: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Scaled Gumbel noise from the first 32 bits of a hash of seed and id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def in_order(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with name: their number (from 1) in an order, by sorted ranges; what is summed up is a row for each range."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1
    dealt = settled(ranges.withColumn("lm_range", F.spark_partition_id()).withColumn("lm_at", at))
    earlier = Window.partitionBy(F.lit(0)).orderBy("lm_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("lm_range").agg(F.count("*").alias("n")).select("lm_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lm_before"))
    return dealt.join(F.broadcast(before), "lm_range").withColumn(name, F.col("lm_at") + F.col("lm_before")).drop("lm_range", "lm_at", "lm_before")  # a row for each partition


def importance_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", n: int = NGRAMS, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED
) -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every row of docs; rank is null for those not drawn.

    Words are runs of ASCII letters (A to Z count as a to z), digits and characters beyond ASCII; features are all runs of
    1 to n words, repeats counted. percent of the rows with at least min_words words (rounded down) are drawn: those of the
    highest scores; ties go to the smaller id, a null id last, then either way.
    Null texts have no words and weight 0. A null id is hashed as an empty one. Rows that repeat an id share its noise and are
    rows of their own. Without docs there are no rows; without a target every text is weighed against the smoothed
    uniform distribution. Other columns are not read.
    """
    features = settled(feature_buckets(docs, id_col, text_col, n, buckets))
    gain = gains(bucket_counts(features, buckets), bucket_counts(feature_buckets(target, None, target_text_col, n, buckets), buckets))
    scored = settled(weighted(features, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("lm_row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= min_words
    # scores lie within the range of gains and some 26 * SCALE of noise, so there are at most some ten thousands of them
    at = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"))
    counts = scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(at))
    wanted = scored.filter(able).count() * percent // 100
    last = counts.filter(F.col("upto") - F.col("n") < wanted).agg(F.min("score")).first()[0]
    near = able & (F.col("score") >= last) if last is not None else F.lit(False)
    numbered = in_order(scored.filter(near), [F.desc("score"), F.asc_nulls_last("id"), F.col("lm_row")], "rank")
    rank = F.when(F.col("rank") <= wanted, F.col("rank"))
    all_rows = numbered.withColumn("rank", rank).unionByName(scored.filter(~near).withColumn("rank", F.lit(None).cast("long")))
    return all_rows.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
