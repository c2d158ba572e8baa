"""Exact top-k by inner product, by no-random-access aggregation of sorted lists.

The candidates are dealt into blocks; a block keeps, for each component, the list of its rows sorted by that component. A
query reads the lists from the end that its weight's sign favours, all to the same depth, and keeps for each row the sum
of what it has seen: with the ends of the lists that is a lower bound of the row's score, with the places reached an upper
bound. It stops when a row met in no list can no longer qualify, and settles the scores of the few whose upper bound still does.

Each query first meets one block; its k-th score there is the bound that rows of all other blocks have to reach. So
the others return few rows, mostly none. Blocks of queries and blocks of candidates have bounded sizes: no task holds more
than one of each, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, settled
from .vectors import EXACT_DOUBLE_BITS, bits_of, integer_vectors, largest, leaders, matrix

K, SCALE = 5, 256
#: Rows of a block of candidates and of a block of queries, on average.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024
#: The lists are read in so many steps.
STEPS = 16
MOST_TASKS = 20_000


class SortedLists:
    """The sorted lists of one block of candidates."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.values, self.exact, self.most = values, values.astype(float), largest(values)
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(self.exact.T, self.order, axis=1)
        self.depths = np.unique(np.append(np.arange(0, n, max(1, -(-n // STEPS)))[1:], n))
        self.tops, self.bottoms = self.sorted[:, n - self.depths], self.sorted[:, self.depths - 1]  # the places reached by then

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The exact scores of rows."""
        if bits_of(largest(query), self.most, len(query)) <= EXACT_DOUBLE_BITS:
            return (self.exact @ query.astype(float))[rows].astype(np.int64)
        return self.values[rows] @ query

    def _read(self, q: np.ndarray, begin: int, end: int, given: np.ndarray) -> np.ndarray:
        """For each row the sum, over the lists that have it between two depths, of what it adds beyond given."""
        n, total = len(self.values), np.zeros(len(self.values))
        for of, at in ((np.flatnonzero(q > 0), slice(n - end, n - begin)), (np.flatnonzero(q < 0), slice(begin, end))):
            if len(of):
                total += np.bincount(self.order[of, at].ravel(), (q[of, None] * self.sorted[of, at] - given[of, None]).ravel(), n)
        return total

    def search(self, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, int]:
        """The rows that may be among the k best of those with a score of floor at least (a few more may be in it), and
        how many entries of the lists were read.

        A row's bounds are the sum of what all lists can still add, the least or the most, and of what the lists that have
        been read as far as the row add beyond that. Where floor is given, the places reached tell the depth to read to.
        """
        n, dim = self.values.shape
        q = query.astype(float)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        # where sums are beyond what doubles hold, bounds have some room
        room = 0.0 if bits_of(largest(q), self.most, dim) <= EXACT_DOUBLE_BITS else 1e-9 * float(np.abs(q).sum() * self.most)
        reach = up @ self.tops + down @ self.bottoms  # the most that a row met in no list can have, by depth
        stop, known = None, floor
        if floor > -np.inf:
            stop = next(iter(np.flatnonzero(reach + room < floor - room)), None)
        elif k <= n:
            ends = up * self.sorted[:, 0] + down * self.sorted[:, -1]  # the least that a list can add to a row
            low, depth = np.full(n, ends.sum()), 0
            for step, to in enumerate(self.depths):
                low += self._read(q, depth, to, ends)
                known, depth = np.partition(low, n - k)[n - k], to
                if reach[step] + room < known - room:  # no row outside can qualify
                    stop = step
                    break
        lists = np.count_nonzero(q)
        if stop is None:  # read to the end
            return np.arange(n), n * lists
        most = reach[stop] + self._read(q, 0, self.depths[stop], up * self.tops[:, stop] + down * self.bottoms[:, stop])
        return np.flatnonzero(most + room >= known - room), int(self.depths[stop]) * lists


def top_k(rows: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates (all, if fewer) of each row where queries holds.

    Components become floor(scale * x), x as a double; a score is the integer inner product. Candidates of a query are all
    rows with another id; ties go to the smaller id. Rows with a null id, or one that is no integer, a null vector, or a
    null or non-finite component take no part; shorter vectors count as filled up with zeros; a null in queries is false.
    Rows that repeat an id are rows of their own, as candidates and as queries. No rows give no rows. Scores beyond 62 bits
    are an error. Other columns are not read.
    """
    spark = rows.sparkSession
    table, dim = integer_vectors(rows, id_col, vector_col, scale, {"asks": F.coalesce(queries, F.lit(False))})
    n, asking = table.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-asking // query_rows))
    deal = lambda salt, into: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(into)).cast("int")
    asks = table.filter("asks").select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("v").alias("q"), deal(1, blocks).alias("home"), deal(2, groups).alias("group"))
    given = table.select("id", "v", deal(3, blocks).alias("block"))

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v, ids, own = matrix(left, dim, "q"), matrix(right, dim), right.column("id").to_numpy(), left.column("query_id").to_numpy()
        floors = left.column("least").cast(pa.float64()).to_numpy(zero_copy_only=False)
        at, found, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(q) and len(v):
            lists, (held, times) = SortedLists(v), np.unique(ids, return_counts=True)
            place = np.minimum(np.searchsorted(held, own), len(held) - 1)
            copies = np.where(held[place] == own, times[place], 0)  # rows of a query's own id, which take places, too
            for i, query in enumerate(q):
                floor = -np.inf if np.isnan(floors[i]) else floors[i]
                near, _ = lists.search(query, k + int(copies[i]), floor)
                exact = lists.scores(query, near)
                fit = (ids[near] != own[i]) & (exact >= floor if floor > -np.inf else True)
                near, exact = near[fit], exact[fit]
                if len(near) > 8 * k:
                    fit = exact >= np.partition(exact, len(exact) - k)[len(exact) - k]
                    near, exact = near[fit], exact[fit]
                j = leaders(np.zeros(len(near), np.int64), exact, ids[near], k)
                at.append(np.full(len(j), i)), found.append(ids[near[j]]), scores.append(exact[j])
        at = np.concatenate(at)
        return pa.table({"query_row": left.column("query_row").to_numpy()[at], "query_id": own[at], "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    def meet(left: DataFrame, right: DataFrame, pairs: int) -> DataFrame:
        tasks = max(partitions(spark), min(pairs, MOST_TASKS))
        left, right = (d.repartition(tasks, "group", "block").groupBy("group", "block") for d in (left, right))
        return left.cogroup(right).applyInArrow(local, "query_row long, query_id long, vec_id long, score long")

    none = F.lit(None).cast("long").alias("least")
    found = meet(asks.select("query_row", "query_id", "q", none, F.lit(0).alias("group"), F.col("home").alias("block")), given.withColumn("group", F.lit(0)), blocks)
    if blocks > 1:
        home = settled(found)
        bound = home.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        others = asks.join(bound, "query_row", "left").withColumn("block", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(blocks - 1)), F.array("home"))))
        everywhere = given.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        found = home.unionByName(meet(others.select("query_row", "query_id", "q", "least", "group", "block"), everywhere, blocks * groups))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
