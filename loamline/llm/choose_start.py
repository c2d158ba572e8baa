"""How the toxicity model's start bias is chosen: python -m loamline.llm.choose_start SF_DIR [ROWS].

Only rows that op4 may learn from are read: of the three folds by crc32 the held-out one is left out, and each of the
other two is scored by a model of the other. A start is as good as its mean log loss over both.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .subword import TRAIN_ROWS, held_out, training_sample

FOLDS, HELD_OUT, STARTS = 3, 1, (-3.0, -5.0, -7.0, -9.0, -11.0)


def loss(model: toxicity.ToxicityModel, sample: list[tuple[bytes, int]]) -> float:
    """The mean log loss of labelled texts; a probability counts as one part in a million at least."""
    p = np.clip([model.score(model.sentences(text)) for text, _ in sample], 1e-6, 1 - 1e-6)
    y = np.array([label for _, label in sample])
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def losses(samples: list[list[tuple[bytes, int]]], starts: tuple[float, ...] = STARTS) -> dict[float, float]:
    """For each start the mean loss over the folds, each scored by a model of the others."""
    out = {}
    for start in starts:
        rest = lambda i: [row for j, s in enumerate(samples) if j != i for row in s]
        out[start] = float(np.mean([loss(toxicity.train(rest(i), start=start), s) for i, s in enumerate(samples)]))
    return out


def main() -> None:
    sf_dir, rows = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else TRAIN_ROWS
    spark = SparkSession.builder.getOrCreate()
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    of = lambda fold: labels.filter(held_out("doc_id", FOLDS, fold)).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    found = losses([training_sample(texts, of(fold), rows) for fold in range(FOLDS) if fold != HELD_OUT])
    for start, value in found.items():
        print(f"start {start:g}: loss {value:.5f}")
    print(f"best: {min(found, key=found.get):g}")


if __name__ == "__main__":
    main()
