"""Integer vectors: what the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Scores are whole numbers of at most so many bits; beyond, an error says so.
SCORE_BITS, EXACT_DOUBLE_BITS = 62, 52


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int, more: dict[str, Column]) -> tuple[DataFrame, int]:
    """A settled table of row (unique), id (long), v (array<long>: floor(scale * x) of each component) and more's columns,
    and the length of its vectors.

    Rows with a null id, or one that is no integer, a null vector or any null or non-finite component are left out.
    Shorter vectors get zeros up to the longest one's length, which changes no inner product.
    """
    v, finite = F.col(f"`{vector_col}`"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    kept = rows.filter(F.forall(v, finite)).select(
        F.col(f"`{id_col}`").try_cast("long").alias("id"), F.transform(v, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"), *[c.alias(k) for k, c in more.items()]
    )
    table = settled(kept.filter("id IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
    dim = table.agg(F.max(F.size("v"))).first()[0] or 0
    return table.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v")))), dim


def matrix(table: pa.Table, dim: int, column: str = "v") -> np.ndarray:
    """The vectors of a table as the rows of an int64 matrix."""
    flat = table.column(column).combine_chunks().flatten() if table.num_rows else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(table.num_rows, dim)


def largest(a: np.ndarray) -> float:
    """The largest magnitude of a component."""
    return float(np.abs(a.astype(float)).max(initial=0))


def bits_of(a: float, b: float, dim: int) -> float:
    """A bound of the bits of any partial sum of an inner product of vectors with such components; above SCORE_BITS an error."""
    bits = np.log2(max(1.0, a * b * max(1, dim)))
    if bits > SCORE_BITS:
        raise ValueError("inner products of these vectors may not fit in 64 bits; take a smaller scale")
    return float(bits)


def score_bits(a: np.ndarray, b: np.ndarray) -> float:
    """bits_of the rows of a and b."""
    return bits_of(largest(a), largest(b), a.shape[1])


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All exact inner products of the rows of a and b, as int64."""
    if score_bits(a, b) <= EXACT_DOUBLE_BITS:  # then every partial sum is exact in doubles
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, eligible: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best eligible entries of each row of scores; ties go to the smaller id, then either way."""
    if not scores.size or not k:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least = np.iinfo(np.int64).min
    masked = np.where(eligible, scores, least)
    k = min(k, masked.shape[1])
    kth = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
    i, j = np.nonzero((masked >= kth[:, None]) & (masked > least))  # k a row, and ties of the last
    first = leaders(i, masked[i, j], ids[j], k)
    return i[first], j[first]


def leaders(of: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each value of of, the best first; ties go to the smaller id, then either way."""
    order = np.lexsort((ids, -scores, of))
    of = of[order]
    return order[np.arange(len(of)) - np.searchsorted(of, of, "left") < k]
