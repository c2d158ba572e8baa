"""Words and their character n-grams as hashed features, whole batches of words at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An odd multiplier of the polynomial hashes (fixed value).
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words a worker remembers; beyond this it forgets them all and goes on, which costs time only.
MAX_WORDS = 200_000
#: New words that are computed at once, which bounds the arrays of their n-grams.
COMPUTED_AT_ONCE = 4096
#: Bounds of the sample a model is fitted on: rows of each label, and bytes of a row's text.
TRAIN_ROWS, TRAIN_BYTES = 3000, 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, each between < and >; the start and the length of each."""
    data = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    return data, np.cumsum(sizes) - sizes, sizes


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not words:
        return np.empty(0, np.uint64)
    data, starts, sizes = _joined(words)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(sizes.max()), BASE, np.uint64))
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        return mix(np.add.reduceat(mix(data + power[place]) * power[place], starts))


def ngram_hashes(words: list[bytes], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words' n-grams of bytes, word ends marked, and the index of each one's word."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data, starts, lengths = _joined(words)
    word = np.repeat(np.arange(len(words)), lengths)
    end = np.repeat(starts + lengths, lengths)
    place = np.arange(len(data))
    out, of = [], []
    with np.errstate(over="ignore"):
        for n in sizes:
            if len(data) < n:
                continue
            h = np.full(len(data) - n + 1, n, np.uint64)
            for i in range(n):
                h = h * BASE + data[i : len(data) - n + 1 + i]
            inside = place[: len(h)] + n <= end[: len(h)]
            out.append(mix(h[inside]))
            of.append(word[: len(h)][inside])
    return np.concatenate(out), np.concatenate(of)


class WordTable:
    """Remembers values of words. compute: from a list of new words to arrays with a row for each."""

    def __init__(self, compute: Callable[[list], list[np.ndarray]], max_words: int = MAX_WORDS):
        self.compute, self.max_words, self.index, self.columns = compute, max_words, {}, None

    def rows(self, words: list) -> np.ndarray:
        """The row of each word in columns; these rows hold until the next call."""
        new = set(words).difference(self.index)
        if new and len(self.index) + len(new) > self.max_words:
            self.index, self.columns = {}, None
            new = set(words)
        if new:
            fresh = list(new)
            parts = [self.compute(fresh[i : i + COMPUTED_AT_ONCE]) for i in range(0, len(fresh), COMPUTED_AT_ONCE)]
            made = [np.concatenate(column) for column in zip(*parts, strict=True)]
            at = len(self.index)
            if self.columns is None or at + len(fresh) > len(self.columns[0]):
                room = max(1 << 12, 2 * (at + len(fresh)))
                grown = [np.zeros((room, *m.shape[1:]), m.dtype) for m in made]
                for g, c in zip(grown, self.columns or [], strict=False):
                    g[:at] = c[:at]
                self.columns = grown
            for c, m in zip(self.columns, made, strict=True):
                c[at : at + len(fresh)] = m
            self.index.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


_tables: dict[str, WordTable] = {}


def worker_table(name: str, compute: Callable[[list], list[np.ndarray]]) -> WordTable:
    """The table of this name in this Python worker; workers outlive tasks, so later tasks find the words known."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = WordTable(compute)
    return _tables[name]


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether the row is in the fold that is never learned from: crc32 of the id as text, modulo folds."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _smallest(known: DataFrame, rows: int) -> list[tuple[object, object]]:
    """(id, label) of each label's ids of the smallest hashes: labels are counted, then ids below a hash are read."""
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count_distinct("id").alias("n")).collect()}
    place, picks = F.shiftrightunsigned(F.xxhash64("id", F.lit(17)), 2), []
    share = {k: min(1.0, (rows + 6 * rows**0.5 + 20) / n) for k, n in counts.items()}
    while counts:
        below = F.lit(False)
        for k in sorted(counts):
            below = below | ((F.col("label") == F.lit(k)) & (place <= F.lit(int(share[k] * (1 << 62)))))
        found = {k: [] for k in counts}
        for r in known.filter(below).select("id", "label", place.alias("place")).distinct().collect():  # about rows of each label
            found[r["label"]].append((r["place"], r["id"]))
        for k, ids in found.items():
            if len(ids) >= min(rows, counts[k]):
                picks += [(i, k) for _, i in sorted(ids)[:rows]]
                del counts[k]
            share[k] = min(1.0, 2 * share[k])
    return picks


def training_sample(texts: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> list[tuple[bytes, object]]:
    """Texts (columns id, text) and labels (id, label): of each label the ids of the smallest hashes, texts not too long.

    Ids are chosen from the labels alone, so no text moves but those of the sample. Bounded: rows of each label times
    max_bytes; labels are expected to be few. A chosen id whose text is longer than max_bytes teaches nothing. The same
    tables give the same sample in the same order. Null ids, texts and labels teach nothing; empty tables give none.
    """
    known = labels.filter("id IS NOT NULL AND label IS NOT NULL").select("id", "label")
    picked = labels.sparkSession.createDataFrame(sorted(set(_smallest(known, rows)), key=str), known.schema)
    small = texts.filter("text IS NOT NULL").filter(F.octet_length("text") <= max_bytes)
    found = small.join(F.broadcast(picked), "id").dropDuplicates(["id", "label"]).select(F.xxhash64("id", F.lit(17)).alias("key"), F.col("text").cast("binary").alias("text"), "label")
    return [(bytes(r["text"]), r["label"]) for r in sorted(found.collect(), key=lambda r: (r["key"], r["text"], r["label"]))]
