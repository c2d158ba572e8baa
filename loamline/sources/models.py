"""Embedding models from files that are pinned by hash."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wordpiece import PADDING, WordPieces
from .files import Files

VOCABULARY, VECTORS, NETWORK = "vocab.txt", "vectors.npy", "model.onnx"
#: Ids of a text that a sentence model reads, as its kind defines it.
MAX_IDS = 512


def file_hashes(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """name, length and sha256 of a folder's files with these names (2 GB at most each); hashed where they are read."""
    rows = spark.read.format("binaryFile").load([f"{folder.rstrip('/')}/{n}" for n in names])
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, folder: str, pins: dict[str, str]) -> list[str]:
    """The paths of the pinned files (name to SHA-256); a ValueError names those that differ."""
    there = [n for n in pins if Files(spark).exists(f"{folder.rstrip('/')}/{n}")]
    found = {r["name"]: r["sha256"] for r in file_hashes(spark, folder, there).collect()} if there else {}  # a row for each pin
    wrong = sorted(n for n, h in pins.items() if found.get(n) != h.lower())
    if wrong:
        raise ValueError(f"files in {folder} differ from their pins: {', '.join(wrong)}")
    return [f"{folder.rstrip('/')}/{n}" for n in pins]


def _lines(content: bytes) -> list[str]:
    return content.decode("utf-8").removesuffix("\n").split("\n")


def shipped(spark: SparkSession, folder: str, pins: dict[str, str]) -> Broadcast[dict[str, bytes]]:
    """The verified contents of the pinned files by name, for workers to load; models that share names don't meet."""
    rows = spark.read.format("binaryFile").load(verified(spark, folder, pins)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return spark.sparkContext.broadcast({r["name"]: bytes(r["content"]) for r in rows.collect()})  # one model, as pinned


class VectorFiles:
    """An embedder by pinned files: a vocabulary, one word a line, and a matrix with a row of floats for each word.

    A text's vector is the mean of its words' rows, of unit length; zeros if it has no known word. Files are verified
    once and broadcast to the workers, which load them on first use.
    """

    def __init__(self, spark: SparkSession, folder: str, pins: dict[str, str]):
        if set(pins) != {VOCABULARY, VECTORS}:
            raise ValueError(f"pin {VOCABULARY} and {VECTORS}")
        self._files = shipped(spark, folder, pins)
        self._loaded: tuple[dict[str, int], np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {"_files": self._files, "_loaded": None}

    def _model(self) -> tuple[dict[str, int], np.ndarray]:
        if self._loaded is None:
            words = {w: i for i, w in enumerate(_lines(self._files.value[VOCABULARY]))}
            vectors = np.load(io.BytesIO(self._files.value[VECTORS]), allow_pickle=False).astype(np.float32)
            if vectors.ndim != 2 or len(vectors) != len(words):
                raise ValueError(f"{len(words)} words for vectors of shape {vectors.shape}")
            self._loaded = words, vectors
        return self._loaded

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        words, vectors = self._model()
        out = np.zeros((len(texts), vectors.shape[1]), np.float32)
        for i, text in enumerate(texts):
            known = [words[w] for w in text.lower().split() if w in words]
            if known:
                mean = vectors[known].mean(axis=0)
                out[i] = mean / (np.linalg.norm(mean) or 1)
        return out


class SentenceModel:
    """An embedder by pinned files: a word piece vocabulary and a transformer in ONNX format that gives a row for each id.

    A text's vector is the mean of its ids' rows, of unit length. Like the models of this kind it reads the first
    max_ids ids of a text; passages are cut into chunks before. Files are verified once and broadcast to the workers; a
    worker opens one session, of one thread, on first use.
    """

    def __init__(self, spark: SparkSession, folder: str, pins: dict[str, str], max_ids: int = MAX_IDS):
        if set(pins) != {VOCABULARY, NETWORK}:
            raise ValueError(f"pin {VOCABULARY} and {NETWORK}")
        self.max_ids, self._files, self._loaded = max_ids, shipped(spark, folder, pins), None

    def __getstate__(self) -> dict:
        return {"max_ids": self.max_ids, "_files": self._files, "_loaded": None}

    def _model(self):
        if self._loaded is None:
            import onnxruntime

            pieces = WordPieces(_lines(self._files.value[VOCABULARY]))
            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = options.inter_op_num_threads = 1
            self._loaded = pieces, onnxruntime.InferenceSession(self._files.value[NETWORK], options, providers=["CPUExecutionProvider"])
        return self._loaded

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        pieces, session = self._model()
        ids = [pieces.encode(t, self.max_ids) for t in texts]
        width = max(map(len, ids), default=0)
        given = np.full((len(ids), width), pieces.ids.get(PADDING, 0), np.int64)
        mask = np.zeros((len(ids), width), np.int64)
        for i, row in enumerate(ids):
            given[i, : len(row)], mask[i, : len(row)] = row, 1
        known = {"input_ids": given, "attention_mask": mask, "token_type_ids": np.zeros_like(given)}
        rows = session.run(None, {i.name: known[i.name] for i in session.get_inputs()})[0].astype(np.float32)
        mean = (rows * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1e-9)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype(np.float32)
