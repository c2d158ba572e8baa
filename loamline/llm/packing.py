"""Packing along a space-filling curve.

Hashed vectors of the documents' tokens are projected to three dimensions, and documents are range-sorted by the
Hilbert key of the projection, so neighbours on the curve have similar words. Along that order all ids form one
stream, which is cut every 2048 ids: no sequence but the last has room, and the last is cut into powers of two.

Token ids are computed once and kept in the checkpoint folder. Ranges hold about RANGE_TOKENS tokens each, so their
number follows the size of the corpus and a task's does not; their bounds come from a quantile sketch of the keys, each
key counted once for every WEIGHT tokens of its document. The ids cross the network once; the number of ids before each
range is a sum over ranges. The key's low bits hash the document id: a large group of copies (one point of the curve) is
spread over as many ranges as its share. A single document is never spread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled
from .tokens import bounded_batches, default_tokenizer, encoder

SEQUENCE, END_ID = 2048, 1
#: Tokens of a range, and tokens that a key stands for once in the sketch of the range bounds.
RANGE_TOKENS, WEIGHT = 1 << 23, 1024
DIMS, DIM_BITS, TIE_BITS, HASHED = 3, 12, 27, 256


def hilbert_key(points: np.ndarray, bits: int = DIM_BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of points (integers under 2**bits), by Skilling's bit transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def project(ids: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """A document's point: its ids hashed into a vector of root counts of unit length, and projected."""
    counts = np.sqrt(np.bincount((ids.astype(np.int64) * 2654435761 >> 7) % HASHED, minlength=HASHED))
    norm = np.linalg.norm(counts)
    return counts @ plane / norm if norm else np.zeros(plane.shape[1])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str, seed: int) -> DataFrame:
    """id, ids (binary), n and curve of each document."""
    plane = np.random.default_rng(seed).standard_normal((HASHED, DIMS))
    plane -= plane.mean(axis=0)  # what all documents have in common says nothing about neighbours

    def encode(batches):
        e = encoder(path)
        end = np.array([END_ID], e.dtype)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            rows = [np.concatenate([e.ids(t), end]) for t in texts]
            at = np.array([project(r, plane) for r in rows]).reshape(len(rows), DIMS)
            grid = np.clip((at / 6 + 0.5) * (1 << DIM_BITS), 0, (1 << DIM_BITS) - 1).astype(np.int64)
            tie = _mix(np.array([-1 if k is None else k for k in keys.to_pylist()], np.int64)) >> np.uint64(64 - TIE_BITS)
            curve = (hilbert_key(grid) << TIE_BITS) | tie.astype(np.int64)
            yield pa.RecordBatch.from_arrays([keys, pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([len(r) for r in rows], pa.int64()), pa.array(curve, pa.int64())], ["doc", "ids", "n", "curve"])

    rows = docs.select(F.col(f"`{id_col}`").try_cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(encode, "doc long, ids binary, n long, curve long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, sequence: int = SEQUENCE, seed: int = 0, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text and END_ID; a null or empty text has END_ID alone. Every id lies in
    exactly one piece. Sequences have 2048 ids, but for the stream's last ids, which form sequences of powers of two.
    Ids are cast to long; one that is no number counts as null. Rows with equal ids (or null ids) are documents of
    their own. An empty table gives no pieces. Other columns are not read. Ties on the curve go by id, then by content,
    so reruns agree. The driver holds two numbers for each range.
    """
    spark = docs.sparkSession
    path = tokenizer_path or default_tokenizer()
    bounded_batches(spark)
    rows = settled(encoded(docs, id_col, text_col, path, seed))
    n = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // range_tokens))
    cuts = [i / n for i in range(1, n)] or [0.5]
    weighed = rows.select("curve", F.explode(F.array_repeat(F.lit(0), F.ceil(F.col("n") / WEIGHT).cast("int"))))
    bounds = np.array(sorted(set(weighed.agg(F.percentile_approx("curve", cuts, max(10_000, 20 * n)).alias("q")).first()["q"] or [])), np.int64)

    @F.pandas_udf("int")
    def range_of(curve: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, curve.to_numpy(), side="left"))

    sums = {r["range"]: r["n"] for r in rows.select("curve", "n").withColumn("range", range_of("curve")).groupBy("range").agg(F.sum("n").alias("n")).collect()}  # a row for each range
    first, total = {}, 0
    for k in sorted(sums):
        first[k], total = total, total + sums[k]
    full = total // sequence * sequence
    tail = [full]  # where the sequences of the last ids end
    for b in range(sequence.bit_length(), -1, -1):
        if (total - full) >> b & 1:
            tail.append(tail[-1] + (1 << b))
    dtype = encoder(path).dtype

    def cut(batches):
        now, at = None, 0
        for b in batches:
            out = []
            for k, doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != now:
                    now, at = k, first[k]
                values = np.frombuffer(ids, dtype).astype("<u4")
                start = 0
                while start < len(values):
                    if at < full:
                        seq, begin = divmod(at, sequence)
                        room = sequence - begin
                    else:
                        i = int(np.searchsorted(tail, at, side="right")) - 1
                        seq, begin, room = full // sequence + i, at - tail[i], tail[i + 1] - at
                    size = min(room, len(values) - start)
                    out.append((doc, start, size, values[start : start + size].tobytes(), len(values), seq, begin))
                    start, at = start + size, at + size
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    dealt = rows.withColumn("range", range_of("curve")).repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "curve", "doc", "ids")
    return dealt.select("range", "doc", "ids").mapInArrow(cut, f"`{id_col}` long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
