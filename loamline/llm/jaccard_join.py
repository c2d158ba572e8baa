"""Exact n-gram Jaccard join by PartEnum signatures.

Sets with a Jaccard similarity of t or more differ in at most d = (1 - t) / (1 + t) * (|r| + |s|) elements. Sets are
sorted into bands of sizes, each twice as large as the last. In a band the domain of shingles is cut into ranges, the
first-level partitions, and each of these into three second-level ones. A signature is a subset of two of the three with
the elements that lie in them; all three subsets are enumerated. Two elements at least must differ in a first-level
partition before similar sets share none of its subsets, so d / 2 + 1 first-level partitions suffice. Subsets without
elements, which all small sets would share, are left out: a partition with elements in one cell only then withstands
no more than one difference, one without elements none, and a set takes partitions in order until together they
withstand more than d. (A set whose partitions do not has one more signature, shared with all such sets.) A set has
signatures in its own band, and in the next if a partner may lie there.

Documents with equal sets are one class. Buckets of two classes name a pair. In larger buckets the class that most
others share buckets with is the hub; the classes of all buckets of a hub are its group, which is how a pair that shares
many signatures meets in few places. Each class meets its hubs first. Then, in each group, classes outside the hub's
component meet those of other components, and each pair is made at the smallest hub that both have, hence once. Groups
are cut into blocks, so that a task meets two blocks, however large the group. A parity sketch of the sets, whose
Hamming distance never exceeds d, is part of the join condition, so pairs that are too far apart are not even made.
Pairs left are compared by a sketch as long as the sets ask for, a bound of the same kind, and those that pass it on
their whole sets, which are built once for each class.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, maybe_broadcast, settled
from .components import components
from .subword import mix, word_hashes, worker_table
from .tokens import bounded_batches

WORDS, THRESHOLD = 4, 85
SKETCH = 8
#: A class with more than one in so many of all rows is hot; fewer classes than this are broadcast.
HOT_SHARE = 1000
#: Classes of a group that one task compares with as many others.
BLOCK = 512
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _hashes(words: list[bytes]) -> list[np.ndarray]:
    return [word_hashes(words)]


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; with fewer words, of the whole sequence."""
    words = text.lower().split() if text else []  # bytes: A to Z only, and the six white-space characters
    if not words:
        return np.empty(0, np.uint64)
    table = worker_table("word hashes", _hashes)
    rows = table.rows(words)
    h = table.columns[0][rows]
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix(out * _ODD[0] + h[i : len(words) - n + 1 + i])
    return np.unique(out)


def _spread(elements: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(elements * _ODD[1] + _ODD[salt])


def furthest(a: int, b: int, threshold: int) -> int:
    """In how many elements sets of these sizes may differ with a similarity of threshold percent."""
    return (100 - threshold) * (a + b) // (100 + threshold)


#: The two of three second-level partitions that make a subset.
_SUBSETS = np.array([(0, 1), (0, 2), (1, 2)])


def signatures(elements: np.ndarray, threshold: int) -> np.ndarray:
    """The signatures of a set (sorted 64-bit hashes), distinct but for chance."""
    n = len(elements)
    if not n:
        return np.empty(0, np.int64)
    out = []
    own = n.bit_length() - 1
    most = 100 * n // threshold  # size of a partner
    sums = np.zeros(n + 1, np.uint64)
    high = elements >> np.uint64(32)
    with np.errstate(over="ignore"):
        np.cumsum(_spread(elements, 2), out=sums[1:])
        for band in range(own, most.bit_length()):
            top = (2 << band) - 1
            parts = int(1.15 * (furthest(top, top, threshold) // 2 + 1)) + 2
            cell = (high * np.uint64(3 * parts)) >> np.uint64(32)  # sorted, as the elements are
            bounds = np.searchsorted(cell, np.arange(3 * parts + 1, dtype=np.uint64))
            part = (sums[bounds[1:]] - sums[bounds[:-1]]).reshape(parts, 3)
            filled = (np.diff(bounds) > 0).reshape(parts, 3)
            withstands = np.minimum(filled.sum(axis=1), 2).cumsum()
            need = furthest(n, min(most, top), threshold) + 1
            used = min(parts, int(np.searchsorted(withstands, need)) + 1)
            x, y = part[:used, _SUBSETS[:, 0]], part[:used, _SUBSETS[:, 1]]
            number = np.arange(3 * used, dtype=np.uint64).reshape(used, 3) * np.uint64(64) + np.uint64(band)
            some = filled[:used, _SUBSETS[:, 0]] | filled[:used, _SUBSETS[:, 1]]
            out.append(mix(mix(x * _ODD[0] + y) * _ODD[1] + number)[some])
            if withstands[-1] < need:
                out.append(mix(np.array([band], np.uint64) + _ODD[3]))
    return np.concatenate(out).view(np.int64)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements in 512 cells: one element more or less changes one bit."""
    odd = np.bincount((elements >> np.uint64(55)).astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def long_sketch(elements: np.ndarray) -> bytes:
    """The size of a set, and parities in two to four cells for each element (a power of two): a 32nd to a 16th of it."""
    n = len(elements)
    bits = max(6, n.bit_length() + 1)
    odd = np.bincount((elements >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8) & 1
    return np.array([n], "<u4").tobytes() + np.packbits(odd).tobytes()


def sketches_near(x: bytes, y: bytes, threshold: int) -> bool:
    """Whether the long sketches of two sets leave room for similarity; the longer one is folded to the other's cells."""
    (n,), (m,) = np.frombuffer(x[:4], "<u4"), np.frombuffer(y[:4], "<u4")
    a, b = (np.unpackbits(np.frombuffer(s[4:], np.uint8)) for s in (x, y))
    while len(a) != len(b):
        a, b = (a.reshape(-1, 2).sum(axis=1, dtype=np.uint8) & 1, b) if len(a) > len(b) else (a, b.reshape(-1, 2).sum(axis=1, dtype=np.uint8) & 1)
    return int((a ^ b).sum(dtype=np.int64)) <= furthest(int(n), int(m), threshold)


def described(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: int) -> DataFrame:
    """doc, n, fa, fb (a 128-bit hash of the set), sigs, k0 to k7 (the sketch) and mark (the long one) of each row."""
    bounded_batches(docs.sparkSession)
    cells = [f"k{i}" for i in range(SKETCH)]

    def run(batches):
        for b in batches:
            sets = [shingles(t, size) for t in b.column(1).to_pylist()]
            with np.errstate(over="ignore"):
                prints = np.array([[_spread(s, 0).sum(dtype=np.uint64), _spread(s, 1).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            marks = np.array([sketch(s) for s in sets], np.int64).reshape(-1, SKETCH)
            columns = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(prints[:, i]) for i in (0, 1)], pa.array([signatures(s, threshold) for s in sets], pa.list_(pa.int64())), *[pa.array(marks[:, i]) for i in range(SKETCH)], pa.array([long_sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "fa", "fb", "sigs", *cells, "mark"])

    rows = docs.select(F.col(f"`{id_col}`").try_cast("long").alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc long, n long, fa long, fb long, sigs array<long>, " + ", ".join(f"{c} long" for c in cells) + ", mark binary")


def _bitmap(sigs: DataFrame, n: int) -> np.ndarray:
    """Bits of those prefixes of hashes that sigs (a column sig, n rows) has: 16 bits for each row, 2 ** 27 at most.

    The driver gets one array of this size, put together from slices that tasks have filled.
    """
    bits = min(27, max(12, (16 * n).bit_length()))
    slices = 64

    def fill(batches):
        now, field = 0, None
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            if field is None and len(at):
                now, field = int(at[0]) * slices >> bits, np.zeros((1 << bits) // slices, bool)
            if len(at):
                field[at.astype(np.int64) % len(field)] = True
        if field is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(field).tobytes()], pa.binary())], ["slice", "field"])

    of = F.shiftrightunsigned("sig", 64 - 6).cast("int")
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = len(out) // slices
    for r in sigs.select("sig").repartitionById(slices, of).mapInArrow(fill, "slice long, field binary").collect():  # one row a slice
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["field"], np.uint8)
    return out


def _named_in(reps: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """rep, sig of reps (rep, sigs): those signatures whose bit is set, chance hits among them."""
    sent = reps.sparkSession.sparkContext.broadcast(bitmap)
    bits = (8 * len(bitmap)).bit_length() - 1

    def pick(batches):
        for b in batches:
            lists = b.column(1)
            sigs = lists.flatten().to_numpy()
            rep = np.repeat(b.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            at = (sigs.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            good = (sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(rep[good]), pa.array(sigs[good])], ["rep", "sig"])

    return reps.select("rep", "sigs").mapInArrow(pick, "rep long, sig long")


def sets_near(x: bytes, y: bytes, threshold: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= threshold * (len(a) + len(b) - both)


def _sets(pairs: DataFrame, built: DataFrame | None, docs: DataFrame, id_col: str, text_col: str, size: int, broadcast_rows: int) -> DataFrame:
    """rep and set (its hashes) of the ends of pairs u, v: those in built, and all others from their texts.

    Beyond the broadcast limit only texts in the wanted ids' buckets move.
    """
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct()
    wanted = settled(wanted if built is None else wanted.join(built, "rep", "left_anti"))
    n_wanted = wanted.count()
    if built is not None and not n_wanted:
        return built

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, size).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["rep", "set"])

    rows = docs.select(F.col(f"`{id_col}`").try_cast("long").alias("rep"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    if n_wanted > broadcast_rows:
        bucket = F.pmod(F.xxhash64("rep"), F.lit(BROADCAST_ROWS)).alias("bucket")
        rows = rows.withColumn("bucket", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
    met = rows.join(maybe_broadcast(wanted, n_wanted, broadcast_rows), "rep", "left_semi")
    made = met.mapInArrow(run, "rep long, set binary").filter(F.octet_length("set") > 0)
    made = settled(made.groupBy("rep", F.xxhash64("set").alias("of")).agg(F.first("set").alias("set")).drop("of"))
    return made if built is None else built.unionByName(made)


def _passing(pairs: DataFrame, values: DataFrame, near: Callable[[bytes, bytes, int], bool], threshold: int) -> DataFrame:
    """Those of the pairs u, v whose values (rep and a binary column) are near; repeated pairs count once."""

    def keep(batches):
        for b in batches:
            good = [near(x, y, threshold) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    value = values.columns[1]
    of = lambda name: values.select(F.col("rep").alias(name), F.col(value).alias(f"of_{name}"))
    met = pairs.join(of("v"), "v").join(of("u"), "u").select("u", "v", "of_u", "of_v")
    return settled(met.mapInArrow(keep, "u long, v long").distinct())


def _near(a: str, b: str, threshold: int) -> Column:
    """Whether two rows, by their sizes and sketches, may be similar enough. No similar pair fails."""
    col = lambda t, c: F.col(f"{t}{c}")
    small, large = F.least(col(a, "n"), col(b, "n")), F.greatest(col(a, "n"), col(b, "n"))
    bits = sum((F.bit_count(col(a, f"k{i}").bitwiseXOR(col(b, f"k{i}"))) for i in range(1, SKETCH)), F.bit_count(col(a, "k0").bitwiseXOR(col(b, "k0"))))
    return (100 * small >= threshold * large) & ((100 + threshold) * bits <= (100 - threshold) * (small + large))


def _labelled(rows: DataFrame, roots: DataFrame, n_roots: int, broadcast_rows: int, of: str = "rep", name: str = "comp") -> DataFrame:
    """rows with name: the root of the class in column of, or itself."""
    known = roots.select(F.col("node").alias(of), F.col("root").alias("lm_root"))
    return rows.join(maybe_broadcast(known, n_roots, broadcast_rows), of, "left").withColumn(name, F.coalesce("lm_root", of)).drop("lm_root")


def _of_one_id(rows: DataFrame, with_class: Callable[[DataFrame], DataFrame], broadcast_rows: int) -> DataFrame:
    """Links u, v between the classes of an id whose rows have several sets."""
    one = F.struct("fa", "fb")
    ids = settled(rows.groupBy("doc").agg(F.min(one).alias("a"), F.max(one).alias("b")).filter("a <> b").select("doc"))
    n_ids = ids.count()
    if not n_ids:
        return rows.sparkSession.createDataFrame([], "u long, v long")
    of = settled(with_class(rows.join(maybe_broadcast(ids, n_ids, broadcast_rows), "doc", "left_semi")).select("doc", F.col("rep").alias("v")).distinct())
    return of.join(of.groupBy("doc").agg(F.min("v").alias("u")), "doc").filter("u < v").select("u", "v")


def _blocks(rows: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK)).cast("int")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: id, n_shingles, class_id and component_id.

    A document's set holds the distinct shingles of so many words of its whole text, after lower-casing A to Z; with
    fewer words the whole sequence is its one shingle. Documents link when 100 * intersection >= threshold * union.
    class_id: the smallest id with the same set; component_id: the smallest id that links reach, itself included.
    Ids are cast to long; one that is no number counts as null. A text without words, or null, has the empty set and is
    linked with nothing. Rows that repeat an id are one document: what links to any of its texts is linked to all of
    them. A null id shares its class's ids and gives none. An empty table gives an empty result. Shingles are compared by
    64-bit hashes. Other columns are not read.
    """
    all_rows = settled(described(docs, id_col, text_col, words, threshold))
    classes = settled(all_rows.filter("n > 0").groupBy("fa", "fb").agg(F.min("doc").alias("rep"), F.count("*").alias("size")))
    cells = [f"k{i}" for i in range(SKETCH)]
    copies = classes.filter("size > 1").select("fa", "fb", "rep", "size")
    n_copies = copies.count()
    others = all_rows.filter("n > 0 AND doc IS NOT NULL")
    hot_above = all_rows.count() // HOT_SHARE

    def with_class(rows: DataFrame) -> DataFrame:
        """rows with rep. Hot classes are few and broadcast; their rows are then dealt by id, which meets nothing."""
        hot = copies.filter(F.col("size") > hot_above).select(F.col("fa").alias("ha"), F.col("fb").alias("hb"), F.col("rep").alias("hot_rep"))
        cold = copies.filter(F.col("size") <= hot_above).select(F.col("fa").alias("ca"), F.col("fb").alias("cb"), F.col("rep").alias("cold_rep"))
        met = rows.join(F.broadcast(hot), (F.col("fa") == F.col("ha")) & (F.col("fb") == F.col("hb")), "left")
        met = met.withColumn("ja", F.when(F.col("ha").isNotNull() | (F.col("n") == 0), F.xxhash64("doc")).otherwise(F.col("fa")))
        met = met.join(maybe_broadcast(cold, n_copies, broadcast_rows), (F.col("ja") == F.col("ca")) & (F.col("fb") == F.col("cb")), "left")
        return met.withColumn("rep", F.coalesce("hot_rep", "cold_rep", "doc")).drop("ha", "hb", "hot_rep", "ja", "ca", "cb", "cold_rep")

    # a class's smallest id represents it: all but the copies' other rows
    reps = with_class(others).filter("doc = rep").select("rep", "n", "sigs", *cells, "mark")
    rows = reps.select("rep", F.explode("sigs").alias("sig"))
    buckets = settled(rows.groupBy("sig").agg(F.count("*").alias("rows"), F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u < v"))
    large = buckets.filter("rows > 2").select("sig", "rows")
    n_large = large.count()
    members = settled(_named_in(reps, _bitmap(large, n_large)).join(maybe_broadcast(large, n_large, broadcast_rows), "sig"))
    central = members.groupBy("rep").agg(F.sum("rows").alias("central"))
    hub_of = members.join(central, "rep").groupBy("sig").agg(F.max(F.struct("central", "rep")).alias("hub")).select("sig", F.col("hub.rep").alias("hub"))
    grouped = settled(members.select("sig", "rep").join(hub_of, "sig").select("hub", "rep").distinct())

    pairs = buckets.filter("rows = 2").select("u", "v").unionByName(grouped.filter("hub <> rep").select(F.least("hub", "rep").alias("u"), F.greatest("hub", "rep").alias("v"))).distinct()
    named = settled(pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct())
    known = settled(reps.select("rep", "n", *cells, "mark").join(maybe_broadcast(named, named.count(), broadcast_rows), "rep", "left_semi").dropDuplicates(["rep", "n", *cells]))
    sizes, marks = known.drop("mark"), known.select("rep", "mark")
    side = lambda name: sizes.select(*[F.col(c).alias(f"{name}_{c}") for c in sizes.columns])
    first = settled(pairs.join(side("a"), F.col("u") == F.col("a_rep")).join(side("b"), F.col("v") == F.col("b_rep")).filter(_near("a_", "b_", threshold)).select("u", "v").distinct())
    first = _passing(first, marks, sketches_near, threshold)
    sets = _sets(first, None, docs, id_col, text_col, words, broadcast_rows)
    links = _passing(first, sets, sets_near, threshold)
    roots = components(links.unionByName(_of_one_id(others, with_class, broadcast_rows)), broadcast_rows)
    n_roots = roots.count()

    labelled = settled(_labelled(_labelled(grouped, roots, n_roots, broadcast_rows), roots, n_roots, broadcast_rows, "hub", "main"))
    open_hubs = labelled.groupBy("hub").agg(F.count("*").alias("rows"), F.count_if(F.col("comp") != F.col("main")).alias("apart")).filter("apart > 0")
    open_hubs = settled(open_hubs.select("hub", _blocks(F.col("rows")).alias("of_rows"), _blocks(F.col("apart")).alias("of_apart")))
    left = labelled.join(maybe_broadcast(open_hubs, open_hubs.count(), broadcast_rows), "hub")
    hubs = left.groupBy("rep").agg(F.collect_set("hub").alias("hubs"))  # a class has no more hubs than signatures
    left = left.join(hubs, "rep").join(sizes, "rep")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    apart = left.filter("comp <> main").withColumn("i", block("of_apart")).withColumn("j", all_of("of_rows"))
    whole = left.withColumn("j", block("of_rows")).withColumn("i", all_of("of_apart"))
    meet = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("hub", "i", "j")]
    once = (F.col("b.comp") == F.col("b.main")) | (F.col("a.rep") < F.col("b.rep"))
    here = F.array_min(F.array_intersect("a.hubs", "b.hubs")) == F.col("a.hub")
    met = apart.alias("a").join(whole.alias("b"), meet[0] & meet[1] & meet[2] & (F.col("a.comp") != F.col("b.comp")) & once & _near("a.", "b.", threshold) & here)
    met = settled(met.select(F.least("a.rep", "b.rep").alias("u"), F.greatest("a.rep", "b.rep").alias("v")))
    met = _passing(met, marks, sketches_near, threshold)
    rest = _passing(met, _sets(met, sets, docs, id_col, text_col, words, broadcast_rows), sets_near, threshold)
    roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(rest), broadcast_rows)

    classed = with_class(all_rows.select("doc", "n", "fa", "fb"))
    out = _labelled(classed, roots, roots.count(), broadcast_rows)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.col("comp").alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without near copies: of each component the document with the smallest id stays.

    Rows of equal id are one document, and one of them stays, whichever of their texts. Rows with a null id stay. An
    empty table gives an empty one. Other columns pass through, whatever their names. Only the ids of documents that go
    or repeat meet the rows; texts move only if these are too many to broadcast.
    """
    joined = jaccard_join(docs, id_col, text_col, words, threshold, broadcast_rows)
    ids = joined.select(F.col(id_col).alias("doc"), "component_id").filter("doc IS NOT NULL")
    facts = settled(ids.groupBy("doc").agg(F.count("*").alias("rows"), F.min("component_id").alias("root")).filter("rows > 1 OR doc <> root"))
    name = fresh(docs, "lm_id")
    gone, again = facts.filter("doc <> root").select(F.col("doc").alias(name)), facts.filter("rows > 1 AND doc = root").select(F.col("doc").alias(name))
    n_gone, n_again = gone.count(), again.count()
    at = F.col(f"`{id_col}`").try_cast("long") == F.col(name)
    stay = docs.join(maybe_broadcast(gone, n_gone, broadcast_rows), at, "left_anti")
    if not n_again:
        return stay
    again = maybe_broadcast(again, n_again, broadcast_rows)
    return stay.join(again, at, "left_anti").unionByName(stay.join(again, at, "left_semi").dropDuplicates([id_col]))
