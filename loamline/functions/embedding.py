"""Passage vectors by a pluggable embedder, and their byte form."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the embedding contract.
PASSAGE, QUERY, BATCH = "passage: ", "query: ", 64
#: Vectors or their bytes that a worker holds at once.
PART = 1024
OFF = ("0", "false", "off", "no")


class Embedder(Protocol):
    """embed() gives a row of floats for each text. Workers get a pickled copy; load what is large on first use."""

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashes of words and their letter trigrams, of unit length: a stand-in where no model is at hand."""

    def __init__(self, dims: int = 256):
        self.dims = dims

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                marked = f"<{word}>"
                for part in {word, *(marked[k : k + 3] for k in range(len(marked) - 2))}:
                    h = zlib.crc32(part.encode())
                    out[i, h % self.dims] += 1 if h >> 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


def enabled(setting: str | None) -> bool:
    """Whether a setting leaves embeddings on; none does."""
    return setting not in OFF


def vectors_of(texts: pa.Array, embedder: Embedder) -> pa.Array:
    """list<float> of each passage; null for a null text. Vectors stay in arrays and never become Python lists."""
    given = texts.drop_null().to_pylist()
    made = embedder.embed([PASSAGE + t for t in given]).astype(np.float32) if given else np.zeros((0, 0), np.float32)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(valid * made.shape[1])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(made.ravel()), mask=pa.array(~valid))


def passage_vectors(text: Column, embedder: Embedder) -> Column:
    """array<float> of each passage; null for a null text. A worker embeds BATCH passages and hands them on, whatever the size
    of the batches that it gets."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at in range(0, len(texts), BATCH):
                yield vectors_of(texts.slice(at, BATCH), embedder)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<float>")(text)


def query_vector(question: str, embedder: Embedder) -> list[float]:
    return embedder.embed([QUERY + question])[0].astype(np.float32).tolist()


def _pack(vectors: pa.Array) -> pa.Array:
    flat = vectors.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4")
    ends = np.append(0, np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    valid = vectors.is_valid().to_pylist()
    return pa.array([flat[i:j].tobytes() if v else None for i, j, v in zip(ends, ends[1:], valid, strict=False)], pa.binary())


def _unpack(blobs: pa.Array) -> pa.Array:
    made = [None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4") for b in blobs.to_pylist()]
    ends = np.append(0, np.cumsum([0 if m is None else len(m) for m in made])).astype(np.int32)
    flat = np.concatenate([np.empty(0, "<f4"), *[m for m in made if m is not None]])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float32()), mask=blobs.is_null())


def _in_parts(kind: str, local: Callable[[pa.Array], pa.Array], x: Column) -> Column:
    """local over PART rows at a time."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            for at in range(0, len(values), PART):
                yield local(values.slice(at, PART))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(x)


def to_bytes(vector: Column) -> Column:
    """Little-endian 32-bit floats, one after another."""
    return _in_parts("binary", _pack, vector)


def from_bytes(blob: Column) -> Column:
    return _in_parts("array<float>", _unpack, blob)
