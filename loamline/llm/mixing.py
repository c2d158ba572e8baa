"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. Sizes are summed by source, and targets are filled up by weight under each source's cap (water filling).
2. Each document has a pseudo-random place u in [0, 1) that depends on the seed and the document alone; a source's
   documents in the order of u are its permutation, and equal intervals of u are its permuted blocks.
3. A source's quota are the blocks of one or more passes over its permutation that its target needs; the last block is
   cut where the words suffice.
4. The quotas of all sources stand at the root of a tree over the output shards. Every node deals its blocks to two
   halves: the left one gets its share of the total, and how many of each source these are is drawn without
   replacement (an urn, block by block), so each leaf has a multivariate-hypergeometric count of blocks by source.
5. A shard draws the next blocks of each source, disjoint from every other shard's, and shuffles its documents locally.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, maybe_broadcast, settled, whole_text

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: Words of an output shard, and blocks of an average shard.
SHARD_WORDS, BLOCKS_PER_SHARD, MIN_SHARDS = 4_000_000, 64, 4
U_BITS = 60


def place(seed: int, *of: Column) -> Column:
    """A document's pseudo-random place as a long under 2 to the 60: the first 15 hex digits of an MD5 sum."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in of])
    return F.conv(F.substring(F.md5(text), 1, U_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_rank, source_size and target, from source and source_size (one row each, a null source too).

    Sources by code point, null last, weigh weights in turn. Together they get share times all sizes; none gets over
    cap times its own size, and what a capped source leaves goes to the others by weight until none is above. The level
    (words by weight) rises from round to round as more sources turn out capped, until none is added: a sum over
    sources each time, whose three numbers come to the driver. Only their numbering is one sorted task.
    """
    in_order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("source_rank", F.lit(len(weights))))
    known = settled(sizes.withColumn("source_rank", F.row_number().over(in_order) - 1).withColumn("w", weight).withColumn("cap", cap * F.col("source_size")))
    goal = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("w") * level if capped >= 0 else F.lit(False)
        seen = known.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if seen["n"] == capped or not seen["w"]:
            break
        level, capped = (goal - seen["taken"]) / seen["w"], seen["n"]
    target = F.least(F.col("cap"), F.col("w") * level) if seen["w"] else F.col("cap")
    return known.select("source", "source_rank", "source_size", target.alias("target"))


def _split(node: Column, seed: int) -> Column:
    """Of each source's blocks at a node (lo, hi, quota: array of source and n), how many go left: array<long>."""
    total = F.aggregate(node.quota, F.lit(0).cast("long"), lambda s, q: s + q.n)
    width = (node.hi - node.lo).cast("long")
    goes = F.floor(total * F.floor(width / 2) / width).cast("long")
    start = F.struct(total.alias("rest"), goes.alias("goes"), F.array().cast("array<bigint>").alias("out"))

    def source(state: Column, q: Column) -> Column:
        blocks = F.when(q.n > 0, F.sequence(F.lit(1).cast("long"), q.n)).otherwise(F.array().cast("array<bigint>"))
        urn = F.aggregate(
            blocks,
            F.struct(state.rest.alias("rest"), state.goes.alias("goes"), F.lit(0).cast("long").alias("x")),
            lambda s, i: F.when(
                F.pmod(F.xxhash64(F.lit(seed), node.lo, node.hi, q.source_rank, i), F.lit(1 << 40)) * s.rest < s.goes * F.lit(float(1 << 40)),
                F.struct((s.rest - 1).alias("rest"), (s.goes - 1).alias("goes"), (s.x + 1).alias("x")),
            ).otherwise(F.struct((s.rest - 1).alias("rest"), s.goes.alias("goes"), s.x.alias("x"))),
        )
        return F.transform(F.array(urn), lambda u: F.struct(u.rest.alias("rest"), u.goes.alias("goes"), F.array_append(state.out, u.x).alias("out")))[0]

    return F.aggregate(node.quota, start, source, lambda s: s.out)


def shard_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """shard, source_rank, n: the leaves of the splitting tree over quotas (source_rank, n).

    The root is one row with a pair of numbers for each source; nodes below name only the sources they have blocks of.
    """
    one = quotas.agg(F.array_sort(F.collect_list(F.struct("source_rank", "n"))).alias("quota"))
    nodes = one.select(F.struct(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "quota").alias("node"))
    for level in range(max(0, math.ceil(math.log2(shards)))):
        node = F.col("node")
        nodes = nodes.withColumn("left", F.when(node.hi - node.lo > 1, _split(node, seed)))
        middle = (node.lo + F.floor((node.hi - node.lo) / 2)).cast("int")
        of = lambda minus: F.zip_with(node.quota, F.col("left"), lambda q, x: F.struct(q.source_rank.alias("source_rank"), (q.n - x if minus else x).alias("n")))  # noqa: E731, B023
        take = lambda minus: F.filter(of(minus), lambda q: q.n > 0)  # noqa: E731, B023
        halves = F.array(F.struct(node.lo.alias("lo"), middle.alias("hi"), take(False).alias("quota")), F.struct(middle.alias("lo"), node.hi.alias("hi"), take(True).alias("quota")))
        nodes = nodes.select(F.explode(F.when(F.col("left").isNull(), F.array(node)).otherwise(halves)).alias("node"))
        if level % 6 == 5:
            nodes = settled(nodes.repartition(min(shards, 1 << level)))
    leaf = nodes.select(F.col("node.lo").alias("shard"), F.explode("node.quota").alias("q"))
    return leaf.select("shard", "q.source_rank", "q.n").filter("n > 0")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    shards: int | None = None,
    seed: int = 0,
    carry: list[str] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, taken, draws, and row where carry names columns.

    size: words of the text (null: 0). taken: the words the mix takes of it, repeats counted. draws: array of struct
    (pass, shard, words, key): each drawing of the document, with its shard and its place in the shard's shuffle. The
    columns in carry are the fields of one struct, named row, so their names meet none of these.
    Null sources form one source, the last. Documents of no words are drawn with their block and add nothing. Repeated
    rows are documents of their own; rows alike in id and text share a place, and a cut between them falls on either,
    which are the same. An empty table gives an empty result. Reruns agree: places depend on seed, id and text only.
    """
    given = [F.col(f"`{c}`").alias(c) for c in (carry or [])]
    text = F.col(f"`{text_col}`")
    base = docs.select(
        F.col(f"`{id_col}`").alias("lm_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.regexp_count(whole_text(text), F.lit(WORD)).cast("long").alias("size"),
        place(seed, F.col(f"`{id_col}`")).alias("u"),
        *([F.struct(*given).alias("row")] if given else []),
    )
    narrow = settled(base) if not given else base
    sources = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    facts = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).first()
    if shards is None:
        shards = max(MIN_SHARDS, 1 << max(0, math.ceil(math.log2(max(1, share * facts["words"] / SHARD_WORDS)))))
    block_words = max(1, facts["words"] // (shards * BLOCKS_PER_SHARD))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")
    known = maybe_broadcast(sources.withColumn("n_blocks", n_blocks).withColumnRenamed("source", "of"), facts["n"], broadcast_rows)
    # u / 2^60 * n_blocks, in integers by halves of u: room for 2^32 blocks of a source
    low = F.shiftright(F.col("u").bitwiseAND(F.lit((1 << U_BITS // 2) - 1)) * F.col("n_blocks"), U_BITS // 2)
    block = F.shiftright(F.shiftright("u", U_BITS // 2) * F.col("n_blocks") + low, U_BITS // 2)
    placed = narrow.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("block", block)

    blocks = placed.groupBy("source_rank", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    along = Window.partitionBy("source_rank").orderBy("block")
    blocks = blocks.withColumn("before", F.sum("words").over(along) - F.col("words"))
    passes = F.explode(F.sequence(F.lit(0), F.lit(max(1, math.ceil(cap)) - 1))).alias("pass")
    quota = F.round("target").cast("long") - F.col("pass") * F.col("source_size")
    drawn = blocks.select("*", passes).withColumn("quota", F.least(quota, F.col("source_size"))).filter("quota > before OR (quota = source_size AND quota >= 0)")
    drawn = drawn.withColumn("cut", F.least(F.col("words"), F.col("quota") - F.col("before")))
    in_draw_order = Window.partitionBy("source_rank").orderBy("pass", "block")
    drawn = settled(drawn.select("source_rank", "block", "pass", "words", "cut", F.row_number().over(in_draw_order).alias("draw")))
    leaves = shard_quotas(drawn.groupBy("source_rank").agg(F.count("*").alias("n")), shards, seed)
    upto = F.sum("n").over(Window.partitionBy("source_rank").orderBy("shard"))
    dealt = leaves.withColumn("last", upto).select("source_rank", "shard", F.explode(F.sequence(F.col("last") - F.col("n") + 1, F.col("last"))).alias("draw"))
    draws = drawn.join(dealt, ["source_rank", "draw"])
    per_block = settled(
        draws.groupBy("source_rank", "block").agg(
            F.array_sort(F.collect_list(F.struct("pass", "shard", "cut", "words"))).alias("drawn"), F.max(F.col("cut") < F.col("words")).alias("partial")
        )
    )
    meet = maybe_broadcast(per_block, per_block.count(), broadcast_rows)
    met = placed.join(meet, ["source_rank", "block"], "left")
    # only a cut block, one a source at most, needs the order of its documents
    within = Window.partitionBy("source_rank", "block").orderBy("u", "lm_id", "size")
    whole = met.filter(~F.coalesce("partial", F.lit(False))).withColumn("ahead", F.lit(0).cast("long"))
    part = met.filter("partial").withColumn("ahead", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    words = lambda d: F.when(d.cut >= d.words, F.col("size")).otherwise(F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), d.cut - F.col("ahead"))))
    made = F.transform(
        F.coalesce("drawn", F.array().cast(per_block.schema["drawn"].dataType)),
        lambda d: F.struct(d["pass"].alias("pass"), d.shard.alias("shard"), words(d).alias("words"), F.xxhash64(F.lit(seed), F.col("u"), d["pass"]).alias("key")),
    )
    out = whole.unionByName(part).withColumn("draws", F.filter(made, lambda d: (d.words > 0) | (F.col("size") == 0)))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d.words)
    draws = F.col("draws").alias("draws", metadata={"shards": shards})
    return out.select(F.col("lm_id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), draws, *(["row"] if given else []))


def mixed(planned: DataFrame) -> DataFrame:
    """The mix itself, from mix(): a row for each drawing of a document, shuffled within its shard.

    Columns: size and row of the document, shard, draw_words (the words that this drawing takes) and draw_key. A task
    takes one shard, and shards are as many as the size of the mix asks for.
    """
    out = planned.select("size", "row", F.explode("draws").alias("draw"))
    out = out.select("size", "row", F.col("draw.shard").alias("shard"), F.col("draw.words").alias("draw_words"), F.col("draw.key").alias("draw_key"))
    return out.repartitionById(planned.schema["draws"].metadata["shards"], F.col("shard")).sortWithinPartitions("shard", "draw_key")
