"""A block-wise inverted index with upper bounds, and BM25 over it that leaves out blocks which cannot matter.

Chunks of a snapshot are dealt by number into ranges of BLOCK; a block holds the postings of one term in one range, its
chunks as offsets in the range, and the impacts of the block: those (tf, d) that no other posting beats in both. From them
the largest score that the term can give any chunk of the range follows for whatever mean length the index has by then.
All terms share the ranges, so the bound of a range is the sum of its blocks' bounds, and a range below the score of the
k-th best chunk so far is never decoded. A frequent term is many blocks, in many tasks; statistics of terms are sums over
the blocks' heads.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phrases import beyond_latin, coded_tokens
from ..functions.text import index_tokens

#: Fixed values of the retrieval contract.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Chunk numbers of a range.
BLOCK = 256
#: Chunks of a task that makes blocks of texts, about: their blocks, some 150 MB as Spark's rows, are sorted without a spill.
PART = 4096
#: Ranges that are scored first, to find what a chunk has to reach.
FIRST_RANGES = 16
RANGE = ["resource_id", "snapshot_id", "block"]
BLOCKS = "resource_id string, snapshot_id string, block long, term string, n int, impacts array<struct<tf:int,d:int>>, at array<int>, tf array<int>, d array<int>, positions array<array<int>>"
#: Parquet's second format codes integers as differences, in nested columns, too.
DELTA = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}


def _largest(block: np.ndarray, tf: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the postings that no other of their block beats: none has more occurrences in a shorter chunk."""
    order = np.lexsort((d, -tf, block))
    by = pd.Series(d[order]).groupby(block[order])
    before = by.cummin().groupby(block[order]).shift(1)
    return order[(before.isna() | (d[order] < before)).to_numpy()]


def invert_range(chunks: pa.Table) -> pa.Table:
    """The blocks of one range from its chunks with tokens (the keys of RANGE, chunk_index and tokens).

    Tokens are coded, and one stable sort of the codes puts the places of each term in each chunk together.
    """
    chunks = chunks.sort_by("chunk_index")
    tokens = chunks.column("tokens").combine_chunks()
    flat, sizes = tokens.flatten(), pc.list_value_length(tokens).to_numpy()
    coded = flat.dictionary_encode()
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    code, chunk, place = codes[order], chunk[order], place[order]
    new = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(chunk, prepend=-1))  # where a posting begins
    ends = np.append(new, len(code))
    tf, term, of = np.diff(ends).astype(np.int32), code[new], chunk[new]
    d = sizes[of].astype(np.int32)
    first = np.flatnonzero(np.diff(term, prepend=-1))  # where a block begins
    blocks = np.append(first, len(term)).astype(np.int32)
    number = np.repeat(np.arange(len(first)), np.diff(blocks))
    index = chunks.column("chunk_index").to_numpy()
    base = chunks.column("block")[0].as_py() * BLOCK
    lists = lambda values: pa.ListArray.from_arrays(blocks, pa.array(values, pa.int32()))
    best = _largest(number, tf, d)
    best = best[np.argsort(number[best], kind="stable")]
    impacts = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(number[best], minlength=len(first)))).astype(np.int32), pa.StructArray.from_arrays([pa.array(tf[best]), pa.array(d[best])], ["tf", "d"]))
    positions = pa.ListArray.from_arrays(blocks, pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(place, pa.int32())))
    out = {c: pa.array([chunks.column(c)[0].as_py()] * len(first), chunks.column(c).type) for c in RANGE}
    return pa.table(out | {"term": coded.dictionary.take(pa.array(term[first])), "n": pa.array(np.diff(blocks), pa.int32()), "impacts": impacts, "at": lists(index[of] - base), "tf": lists(tf), "d": lists(d), "positions": positions})


def invert(chunks: DataFrame) -> DataFrame:
    """The blocks (BLOCKS) of chunks (resource_id, snapshot_id, chunk_index, tokens). A task holds BLOCK chunks at once.

    Chunks without tokens have no postings; null tokens count as none.
    """
    rows = chunks.select("resource_id", "snapshot_id", F.floor(F.col("chunk_index") / BLOCK).alias("block"), F.col("chunk_index").cast("long").alias("chunk_index"), "tokens")
    return rows.filter(F.size("tokens") > 0).groupBy(*RANGE).applyInArrow(invert_range, BLOCKS)


def _text_range(chunks: pa.Table, times: int) -> pa.Table:
    """invert_range of chunks with texts, and with the tokens of those texts that are not of Latin-1 (see invert_texts)."""
    chunks = chunks.sort_by("chunk_index")
    both = lambda *names: pa.concat_arrays([x for n in names for x in chunks.column(n).chunks])
    coded, begin, size = coded_tokens(both("head", "content"), both("head_tokens", "tokens"))
    begin, size = (np.stack([x[: len(chunks)], *[x[len(chunks) :]] * times], 1).ravel() for x in (begin, size))
    ends = np.cumsum(size)
    flat = coded.take(pa.array(np.arange(ends[-1]) + np.repeat(begin - ends + size, size)))
    tokens = pa.ListArray.from_arrays(np.append(0, ends[times :: times + 1]).astype(np.int32), flat)
    return invert_range(chunks.select([*RANGE, "chunk_index"]).append_column("tokens", tokens))


def invert_texts(chunks: DataFrame, n: int, times: int = 1) -> DataFrame:
    """invert of chunks (resource_id, snapshot_id, chunk_index, head, content) whose tokens are those of head and then times
    those of content, neither null. n: about how many there are.

    A text moves once, to its range, and becomes tokens there; neither its tokens nor its blocks move.
    """
    rows = chunks.select("resource_id", "snapshot_id", F.floor(F.col("chunk_index") / BLOCK).alias("block"), F.col("chunk_index").cast("long").alias("chunk_index"), "head", "content")
    parts = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-n // PART))
    there = rows.repartition(parts, *RANGE).sortWithinPartitions(*RANGE)  # so that groups need no sort of tokens
    others = [F.when(beyond_latin(F.col(x)), index_tokens(F.col(x))).alias(name) for x, name in (("head", "head_tokens"), ("content", "tokens"))]

    def run(part: pa.Table) -> pa.Table:
        return _text_range(part, times)

    return there.select(*there.columns, *others).groupBy(*RANGE).applyInArrow(run, BLOCKS)


def stored_blocks(blocks: DataFrame, path: str) -> DataFrame:
    """blocks written to path and read from there. Each file is in the order of terms, so a question reads the pages with its
    terms, and of those the columns that it needs, most never positions."""
    named = {f"parquet.enable.dictionary#{c}": "true" for c in RANGE}
    blocks.sortWithinPartitions("term", *RANGE).write.options(**DELTA, **named, **{"parquet.page.row.count.limit": "1024"}, compression="zstd").parquet(path)
    return blocks.sparkSession.read.schema(BLOCKS).parquet(path)


def _named(words: list[str]) -> Column:
    """Whether term is one of words. Of more than ten values in one test Parquet's filter sees the ends alone."""
    return reduce(lambda x, y: x | y, [F.col("term").isin(words[i : i + 10]) for i in range(0, len(words), 10)], F.lit(False))


def _phrase_blocks(blocks: DataFrame, phrase: list[str]) -> DataFrame:
    """The blocks of a phrase of several words, without positions: only ranges that have all its words are decoded.

    Blocks move once, by range; every later grouping is within a range.
    """
    words = sorted(set(phrase))
    mine = blocks.filter(_named(words)).select(*RANGE, "term", "at", "d", "positions").repartition(*RANGE)
    whole = mine.withColumn("found", F.count("*").over(Window.partitionBy(*RANGE))).filter(F.col("found") == len(words))
    at = F.element_at(F.create_map(*[x for w in words for x in (F.lit(w), F.array(*[F.lit(j) for j, p in enumerate(phrase) if p == w]))]), F.col("term"))
    rows = whole.select(*RANGE, at.alias("places"), F.explode(F.arrays_zip("at", "d", "positions")).alias("p"))
    begins = F.flatten(F.transform("p.positions", lambda i: F.transform("places", lambda j: i - j)))
    begun = rows.select(*RANGE, "p.at", "p.d", F.explode(begins).alias("begin")).groupBy(*RANGE, "at", "d", "begin").agg(F.count("*").alias("n"))
    found = begun.filter(F.col("n") == len(phrase)).groupBy(*RANGE, "at", "d").agg(F.count("*").cast("int").alias("tf"))
    each = found.groupBy(*RANGE).agg(F.collect_list(F.struct("at", "tf", "d")).alias("each"))  # BLOCK at most
    return each.select(*RANGE, F.lit(" ".join(phrase)).alias("term"), F.size("each").alias("n"), F.transform("each", lambda e: F.struct(e.tf.alias("tf"), e.d.alias("d"))).alias("impacts"), *[F.col(f"each.{c}").alias(c) for c in ("at", "tf", "d")])


def _weight(tf: Column, d: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * d / F.lit(mean)))


@dataclass
class Ranked:
    """The best chunks (resource_id, snapshot_id, chunk_index, score), the best first; the ranges that were decoded, or None
    for all of them; and the number of chunks that each phrase is in."""

    best: pa.Table
    decoded: DataFrame | None
    frequency: dict[str, int]


HIT = pa.schema([("resource_id", pa.string()), ("snapshot_id", pa.string()), ("chunk_index", pa.int64()), ("score", pa.float64())])
ORDER = [("score", "descending"), ("resource_id", "ascending"), ("snapshot_id", "ascending"), ("chunk_index", "ascending")]


def bm25_top(blocks: DataFrame, n: int, tokens: int, phrases: list[list[str]], limit: int, allowed: DataFrame | None = None, first: int = FIRST_RANGES) -> Ranked:
    """The limit best chunks by BM25; equal scores go in the order of keys.

    n and tokens: the number of chunks of the whole index and of their tokens. allowed: resource_id of those that are
    ranked at all; frequencies are those of the whole index. The driver holds the phrases' frequencies, the keys of
    the first ranges and limit rows.
    """
    singles, several = [p[0] for p in phrases if len(p) == 1], [p for p in phrases if len(p) > 1]
    if not phrases or not n or limit <= 0:
        return Ranked(HIT.empty_table(), None, {})
    lists = blocks.filter(_named(singles)).select(*RANGE, "term", "n", "impacts", "at", "tf", "d")
    if several:
        lists = lists.unionByName(reduce(DataFrame.unionByName, [_phrase_blocks(blocks, p) for p in several])).persist()
    try:
        return _top_of(lists, n, tokens, limit, allowed, first)
    finally:
        if several:
            lists.unpersist()


def _top_of(lists: DataFrame, n: int, tokens: int, limit: int, allowed: DataFrame | None, first: int) -> Ranked:
    spark = lists.sparkSession
    counted = lists.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("ranges")).collect()  # a row for each phrase
    frequency = {r["term"]: int(r["n"]) for r in counted}
    if not frequency:
        return Ranked(HIT.empty_table(), None, frequency)
    raw = {t: math.log((n - df + 0.5) / (df + 0.5)) for t, df in frequency.items()}
    idf = F.element_at(F.create_map(*[F.lit(x) for t, v in raw.items() for x in (t, v if v > 0 else LEAST_IDF)]), F.col("term"))
    mean = tokens / n
    if allowed is not None:
        lists = lists.join(allowed.select("resource_id").distinct(), "resource_id", "left_semi")

    def best(some: DataFrame, least: float = 0.0) -> pa.Table:
        each = some.select(*RANGE, idf.alias("idf"), F.explode(F.arrays_zip("at", "tf", "d")).alias("p"))
        part = F.col("idf") * _weight(F.col("p.tf"), F.col("p.d"), mean)
        total = each.groupBy(*RANGE, F.col("p.at").alias("at")).agg(F.round(F.sum(part), 6).alias("score")).filter(F.col("score") >= least)
        rows = total.select("resource_id", "snapshot_id", (F.col("block") * BLOCK + F.col("at")).alias("chunk_index"), "score")
        return rows.orderBy(F.desc("score"), "resource_id", "snapshot_id", "chunk_index").limit(limit).toArrow().cast(HIT)  # limit rows

    if max(r["ranges"] for r in counted) <= first:
        return Ranked(best(lists), None, frequency)
    most = idf * F.array_max(F.transform("impacts", lambda i: _weight(i.tf, i.d, mean)))
    bounds = lists.select(*RANGE, most.alias("most")).groupBy(*RANGE).agg(F.sum("most").alias("most"))
    begin = [tuple(r) for r in bounds.orderBy(F.desc("most"), *RANGE).limit(first).select(*RANGE).collect()]
    key = F.struct(*RANGE)
    among = lambda rows: key.isin([F.struct(F.lit(a), F.lit(b), F.lit(c).cast("long")) for a, b, c in rows])
    files = reduce(lambda x, y: x & y, [F.col(c).isin(sorted({r[i] for r in begin})) for i, c in enumerate(RANGE)])
    have = best(lists.filter(files & among(begin)))
    floor = pc.min(have.column("score")).as_py() if have.num_rows == limit else 0.0
    left = bounds.filter(~among(begin) & (F.col("most") >= floor - 1e-5)).select(*RANGE)  # scores are rounded
    rest = best(lists.join(left, RANGE, "left_semi"), floor)
    decoded = spark.createDataFrame(begin, "resource_id string, snapshot_id string, block long").unionByName(left)
    return Ranked(pa.concat_tables([have, rest]).sort_by(ORDER).slice(0, limit), decoded, frequency)
