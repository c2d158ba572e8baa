"""Exact vector search that leaves out what cannot win: vectors lie by the centroid they are nearest to in angle.

A cell's head has its centroid and the largest angle of its vectors to it, so no vector of the cell is nearer to a
question than the angle to the centroid less that radius. Cells are read from the best bound on, until the limit-th
score found beats the bounds of all others; none that could hold a hit is left out. Vectors that have no angle (zeros) or
another length than most are a cell of their own, which is always read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import cosine_scores, top

#: A centroid for so many vectors, and never more than MOST_CELLS: their heads are held by driver and tasks.
CELL_ROWS, MOST_CELLS = 2048, 256
#: The cell of vectors without an angle, the rows of one file, and what rounding may hide.
ODD, FILE_ROWS, SLACK = -1, 1 << 18, 3e-6


def _units(flat: np.ndarray, dim: int) -> np.ndarray:
    rows = flat.reshape(-1, dim)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def write_cells(vectors: DataFrame, path: str, cell_rows: int = CELL_ROWS) -> None:
    """Writes vectors (embedding and other columns, none of them named cell or angle) below path, by cell, and their heads.

    Vectors that are null or empty, which have no score, are left out.
    """
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    dims = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim, n = (dims[0]["d"], dims[0]["n"]) if dims else (1, 0)
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    square = F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x)
    even = (F.size("embedding") == dim) & (square > 0) & (square < float("inf"))
    wanted = min(MOST_CELLS, max(1, -(-n // cell_rows)))
    drawn = [r["v"] for r in rows.filter(even).select(doubles.alias("v"), F.xxhash64("embedding").alias("h")).orderBy("h").limit(wanted).collect()]  # MOST_CELLS at most
    centroids, names = _units(np.array(drawn, float).reshape(-1), dim) if drawn else np.zeros((0, dim)), vectors.columns

    def run(batches):
        for b in batches:
            table = pa.Table.from_batches([b])
            usable = table.column("lm_even").to_numpy()
            cell, angle = np.full(len(usable), ODD, np.int32), np.zeros(len(usable))
            if usable.any():
                flat = table.filter(pa.array(usable)).column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                near = np.clip(_units(flat.astype(float), dim) @ centroids.T, -1, 1)
                cell[usable], angle[usable] = near.argmax(1), np.arccos(near.max(1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(cell), pa.array(angle)], [*names, "cell", "angle"])

    schema = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes)
    dealt = rows.withColumn("lm_even", F.coalesce(even, F.lit(False))).mapInArrow(run, f"{schema}, cell int, angle double")
    spread = F.pmod(F.xxhash64("embedding"), F.lit(max(1, -(-n // FILE_ROWS))))  # so a cell with a third of all vectors is many files
    dealt.repartition("cell", spread).write.partitionBy("cell").parquet(f"{path}/cells")
    kept = vectors.sparkSession.read.parquet(f"{path}/cells") if n else dealt
    heads = kept.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    middles = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    heads.join(F.broadcast(middles), "cell", "left").coalesce(1).write.parquet(f"{path}/heads")  # MOST_CELLS at most


@dataclass
class Found:
    """The hits (the stored columns but the vector, score), the best first; the cells that were read, and how many there are."""

    best: pa.Table
    read: list[int]
    cells: int


def search_cells(spark: SparkSession, path: str, query: list[float], limit: int) -> Found:
    """The limit stored vectors of the highest cosine; ties go to the smaller chunk_key. limit rows reach the driver."""
    heads = spark.read.parquet(f"{path}/heads").collect()  # MOST_CELLS at most
    q = np.array(query, float)
    norm = np.linalg.norm(q)

    def bound(head) -> float:
        if head["centroid"] is None or len(head["centroid"]) != len(q) or norm == 0:
            return 2.0  # nothing is known of it
        angle = float(np.arccos(np.clip(np.dot(head["centroid"], q) / norm, -1, 1)))
        return float(np.cos(min(max(0.0, angle - head["radius"]), np.pi))) + SLACK

    left = sorted(((bound(h), h["cell"], h["n"]) for h in heads), key=lambda x: (-x[0], x[1]))
    stored, best, read = spark.read.parquet(f"{path}/cells") if left else None, None, []
    order = [("score", "descending"), ("chunk_key", "ascending")]
    while left and limit > 0:
        kth = best.column("score")[limit - 1].as_py() if best is not None and best.num_rows >= limit else -2.0
        left = [x for x in left if x[0] >= kth]
        take, rows = [], 0
        while left and (rows < limit or left[0][0] > 1.5 or len(take) < len(read)):  # each wave as large as all before it
            take.append(left[0][1])
            rows += left.pop(0)[2]
        if not take:
            break
        hits = top(cosine_scores(stored.filter(F.col("cell").isin(take)), query), limit, "vector_rank").drop("vector_rank").toArrow()
        best = (hits if best is None else pa.concat_tables([best, hits])).sort_by(order).slice(0, limit)
        read += take
    return Found(best if best is not None else pa.table({"chunk_key": pa.array([], pa.string()), "score": pa.array([], pa.float64())}), read, len(heads))
