"""Hard negatives by a Voronoi-partitioned distributed kNN join.

Inner products become distances: a candidate x gets one more component, sqrt(M^2 - |x|^2) with M the longest candidate's
norm, an anchor a zero; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the highest scores are the nearest neighbours.

A bounded sample of candidates are the pivots; anchors and candidates belong to the cell of their nearest pivot. Anchors
first meet their own cell's candidates, which gives each a bound, and so a range of distances that it still needs; a cell's
candidates have a range of distances to the pivot. An anchor is then copied to just those other cells whose ranges its own
distance to their pivot can meet by the triangle inequality, and every cell is joined exactly. Anchors travel, as they are
the smaller side; a candidate is in its own cell alone. This runs twice: for the positives, and for the windows below the
positives' scores.

A cell's candidates and the anchors it gets are dealt into blocks of bounded sizes, so a cell with a third of all rows is
many tasks, each of which holds SCORES scores at once and returns a few rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, settled
from .vectors import best, inner, integer_vectors, leaders, matrix

POSITIVES, NEGATIVES, LEAST, MOST, SCALE = 5, 3, 50, 95, 256
#: Rows of a block of candidates and of a block of anchors, on average.
BLOCK_ROWS, ANCHOR_ROWS = 4096, 16_384
#: Scores of a block of anchors and one of candidates that a task computes at once.
SCORES = 1 << 20
#: A pivot for so many anchors, and never more than MOST_PIVOTS.
PIVOT_ANCHORS, MOST_PIVOTS, MOST_TASKS = 256, 256, 20_000


class Cells:
    """The pivots; distances to them of candidates and anchors."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.pivots, self.longest = pivots.astype(float), longest  # longest: M^2
        self.more = np.sqrt(np.maximum(longest - (self.pivots**2).sum(1), 0))

    def distances(self, v: np.ndarray, anchors: bool) -> np.ndarray:
        x = v.astype(float)
        own = (x**2).sum(1)
        more = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.longest - own, 0))
        square = (own + more**2)[:, None] + self.longest - 2 * (x @ self.pivots.T + more[:, None] * self.more)
        return np.sqrt(np.maximum(square, 0))


def _placed(cells: Cells, dim: int, anchors: bool) -> Callable:
    """For mapInArrow over rows with v: the cell of the nearest pivot and the distance to it."""

    def run(batches):
        for b in batches:
            d = cells.distances(matrix(pa.Table.from_batches([b]), dim), anchors)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1) if len(d) else np.empty(0), pa.float64())], [*b.schema.names, "cell", "away"])

    return run


def _elsewhere(cells: Cells, dim: int, held: list[tuple[int, float, float]]) -> Callable:
    """For mapInArrow over anchors with v, cell, near and far, the least and the largest distance to a candidate that each
    needs: the other cells that may have one, as a list beside the anchor. held: for each cell with candidates the least and
    the largest of their distances to the pivot."""
    cell, nearest, farthest = (np.array([h[k] for h in held]) for k in range(3))
    slack = 1e-5 * np.sqrt(cells.longest) + 1e-5  # far more than distances are rounded by

    def run(batches):
        for b in batches:
            near, far = (b.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("near", "far"))
            at = cells.distances(matrix(pa.Table.from_batches([b]), dim), True)[:, cell]
            goes = (np.maximum(at - farthest, nearest - at) <= far + slack) & (at + farthest >= near - slack)
            goes &= cell != b.column("cell").to_numpy()[:, None]
            ends = np.append(0, np.cumsum(goes.sum(1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(cell[np.nonzero(goes)[1]], pa.int32()))], [*b.schema.names, "cells"])

    return run


def _slices(left: pa.Table, right: pa.Table) -> list[slice]:
    """The rows of left in slices that have SCORES scores with right, at most; one row at least."""
    step = max(1, SCORES // max(1, right.num_rows))
    return [slice(i, i + step) for i in range(0, left.num_rows, step)] if right.num_rows else []


def _result(left: pa.Table, right: pa.Table, parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """parts: for the nth wanted thing of each anchor the rows of left and right that meet, and their scores."""
    cat = lambda k: np.concatenate([np.empty(0, np.int64), *[p[k] for p in parts]])
    nth = np.concatenate([np.empty(0, np.int32), *[np.full(len(p[1]), p[0], np.int32) for p in parts]])
    rows, ids = left.column("row").to_numpy(), right.column("id").to_numpy()
    return pa.table({"row": rows[cat(1)], "nth": nth, "other": ids[cat(2)], "score": cat(3)})


def _same_label(dim: int, k: int) -> Callable:
    """The k best candidates of the anchors' label with a score of least at least, for a group of one label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own, least = right.column("id").to_numpy(), left.column("id").to_numpy(), left.column("least").to_numpy()
        a, b, parts = matrix(left, dim), matrix(right, dim), []
        for at in _slices(left, right):
            scores = inner(a[at], b)
            i, j = _best_of(scores, (own[at, None] != ids) & (scores >= least[at, None]), ids, k)
            parts.append((0, i + at.start, j, scores[i, j]))
        return _result(left, right, parts)

    return run


def _best_of(scores: np.ndarray, eligible: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """best(), by sorting the eligible entries alone where they are few."""
    if np.count_nonzero(eligible) > scores.size // 16:
        return best(scores, eligible, ids, k)
    i, j = np.nonzero(eligible)
    first = leaders(i, scores[i, j], ids[j], k)
    return i[first], j[first]


def _windows(dim: int, wanted: int, k: int) -> Callable:
    """For each of the wanted windows of an anchor the k best candidates of other labels whose score is in it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = right.column("id").to_numpy(), left.column("id").to_numpy()
        codes = pa.concat_tables([left.select(["label"]), right.select(["label"])]).column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        mine, theirs = codes[: left.num_rows], codes[left.num_rows :]
        a, b, parts = matrix(left, dim), matrix(right, dim), []
        low, high = (matrix(left, wanted, c) for c in ("low", "high"))
        for at in _slices(left, right):
            scores = inner(a[at], b)
            some = (scores >= low[at].min(1)[:, None]) & (scores <= high[at].max(1)[:, None]) & (mine[at, None] != theirs) & (own[at, None] != ids)
            if np.count_nonzero(some) > scores.size // 16:
                for w in range(wanted):
                    i, j = _best_of(scores, some & (scores >= low[at, w, None]) & (scores <= high[at, w, None]), ids, k)
                    parts.append((w, i + at.start, j, scores[i, j]))
                continue
            i, j = np.nonzero(some)
            s = scores[i, j]
            for w in range(wanted):
                fit = np.flatnonzero((s >= low[at][i, w]) & (s <= high[at][i, w]))
                fit = fit[leaders(i[fit], s[fit], ids[j[fit]], k)]
                parts.append((w, i[fit] + at.start, j[fit], s[fit]))
        return _result(left, right, parts)

    return run


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    scale: int = SCALE, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS, pivot_anchors: int = PIVOT_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Components become floor(scale * x), x as a double; a score is the integer inner product with the anchor. An anchor's
    positives are the best other rows of its label; a positive's negatives are the best rows of other labels with
    least * positive_score <= 100 * score <= most * positive_score. Ties go to the smaller id. Fewer are all there are; a
    positive without any gives no row.
    Rows with a null id, or one that is no integer, a null label, a null vector, or a null or non-finite component take
    no part; shorter vectors count as filled up with zeros; a null in anchors is false. Rows that repeat an id are rows of
    their own, but rows of one id never serve each other. No rows give no rows. Scores beyond 62 bits are an error. Other
    columns are not read.
    """
    spark = rows.sparkSession
    label = F.col(f"`{label_col}`")
    table, dim = integer_vectors(rows.filter(label.isNotNull()), id_col, vector_col, scale, {"label": label, "asks": F.coalesce(anchors, F.lit(False))})
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, asking, longest = table.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(square), F.lit(0.0))).first()
    wanted = min(MOST_PIVOTS, max(4, -(-asking // pivot_anchors)))
    pivots = [r["v"] for r in table.select("v", F.xxhash64("row").alias("h")).orderBy("h").limit(wanted).collect()]  # MOST_PIVOTS at most
    cells = Cells(np.array(pivots or [[0] * dim], np.int64).reshape(max(1, len(pivots)), dim), longest)

    kind = table.schema["label"].dataType.simpleString()
    columns = f"row long, id long, label {kind}, v array<long>"
    placed = lambda rows, anchors: settled(rows.select("row", "id", "label", "v").mapInArrow(_placed(cells, dim, anchors), f"{columns}, cell int, away double"))
    asked = placed(table.filter("asks"), True).withColumn("square", square)
    others = placed(table, False)
    held = others.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("nearest"), F.max("away").alias("farthest")).collect()  # a row a pivot at most
    if not asking:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    number = lambda of: F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for kv in of.items() for x in kv]), F.col("cell")), F.lit(1))
    blocks = {r["cell"]: -(-r["n"] // block_rows) for r in held}
    at_home = {r["cell"]: -(-r["n"] // anchor_rows) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # likewise
    abroad = dict.fromkeys(blocks, -(-asking // anchor_rows))

    def meet(left: DataFrame, parts: dict[int, int], by: list[str], local: Callable) -> DataFrame:
        """Joins the anchors that have come to each cell with its candidates, a block of each at a time."""
        keys = ["cell", "part", "block", *by]
        deal = lambda into: F.pmod(F.xxhash64("row"), into).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), number(of) - 1))
        left = left.withColumn("part", deal(number(parts))).withColumn("block", every(blocks))
        right = others.select("row", "id", "label", "v", "cell").filter(F.col("cell").isin(list(parts))).withColumn("block", deal(number(blocks))).withColumn("part", every(parts))
        tasks = max(partitions(spark), min(MOST_TASKS, sum(blocks.get(c, 1) * n for c, n in parts.items())))
        left, right = (d.repartition(tasks, *keys).groupBy(*keys) for d in (left, right))
        return left.cogroup(right).applyInArrow(local, "row long, nth int, other long, score long")

    def elsewhere(left: DataFrame, low: Column, high: Column) -> DataFrame:
        """The anchors in left, each in the other cells that may have scores from low to high, what it still needs."""
        to = lambda s: F.sqrt(F.greatest(F.col("square") + longest - 2 * s, F.lit(0.0)))
        given = left.withColumn("near", to(high)).withColumn("far", to(low))
        shape = ", ".join(f"`{c}` {t}" for c, t in given.dtypes)
        gone = given.mapInArrow(_elsewhere(cells, dim, [(r["cell"], r["nearest"], r["farthest"]) for r in held]), f"{shape}, cells array<int>")
        return gone.withColumn("cell", F.explode("cells")).drop("cells", "near", "far")

    def first(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("row", "nth").orderBy(F.desc("score"), "other")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    # the positives: what an anchor has found at home bounds what it needs from elsewhere; scores have no upper end
    none = F.lit(int(np.iinfo(np.int64).min)).alias("least")
    same = _same_label(dim, positives)
    home = settled(meet(asked.select("*", none), at_home, ["label"], same))
    bound = home.groupBy("row").agg(F.when(F.count("*") >= positives, F.min("score")).alias("kth"))
    ends = F.sqrt(F.col("square") * longest)
    bounded = asked.join(bound, "row", "left").withColumn("least", F.coalesce("kth", none))
    away = meet(elsewhere(bounded, F.coalesce(F.col("kth").cast("double"), -ends), ends), abroad, ["label"], same)
    chosen = settled(first(home.unionByName(away), positives).withColumn("nth", F.col("rank") - 1).select("row", "nth", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))

    # the negatives: a window below each positive; one that is empty asks for nothing
    low, high = -F.floor(-F.col("positive_score") * least / 100), F.floor(F.col("positive_score") * most / 100)
    window = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.element_at(F.col("by"), i))
    empty = F.struct(F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))

    def windows(bounds: DataFrame) -> DataFrame:
        """bounds: row, nth, low and high."""
        by = bounds.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("nth", F.struct("low", "high")))).alias("by"))  # positives at most
        each = by.withColumn("each", F.transform(window, lambda w: F.coalesce(w, empty)))
        return asked.join(each.select("row", F.col("each.low").alias("low"), F.col("each.high").alias("high")), "row")

    integers = chosen.select("row", "nth", low.cast("long").alias("low"), high.cast("long").alias("high")).filter("low <= high")
    local = _windows(dim, positives, negatives)
    home = settled(meet(windows(integers), at_home, [], local))
    bound = home.groupBy("row", "nth").agg(F.when(F.count("*") >= negatives, F.min("score")).alias("kth"))
    left = settled(integers.join(bound, ["row", "nth"], "left").select("row", "nth", F.greatest("low", F.coalesce("kth", "low")).alias("low"), "high"))
    wide = left.groupBy("row").agg(F.min("low").cast("double").alias("least"), F.max("high").cast("double").alias("most"))
    away = meet(elsewhere(windows(left).join(wide, "row"), F.col("least"), F.col("most")), abroad, [], local)
    found = first(home.unionByName(away), negatives).select("row", "nth", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = asked.select("row", F.col("id").alias("anchor_id"))
    return found.join(chosen, ["row", "nth"]).join(ids, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
