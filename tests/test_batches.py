"""Workers hold bounded parts of the batches they get."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from loamline.functions import embedding, markdown


def counting():
    """An embedder whose vectors' first component is the number of texts that were embedded at once."""

    class Counting(embedding.HashingEmbedder):
        def embed(self, texts):
            out = super().embed(texts)
            out[:, 0] = len(texts)
            return out

    return Counting(16)


def test_vectors_are_made_and_read_back_in_parts(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"word{i} and more") for i in range(3000)], "i int, t string").coalesce(1)
    d = rows.select("i", "t", embedding.passage_vectors(F.col("t"), counting()).alias("v"))
    d = d.select("*", embedding.to_bytes("v").alias("b")).select("*", embedding.from_bytes("b").alias("w"))
    for r in d.collect():
        if r["t"] is None:
            assert r["v"] is None and r["b"] is None and r["w"] is None
            continue
        want = counting().embed([embedding.PASSAGE + r["t"]])[0]
        assert r["v"][1:] == [float(x) for x in want[1:]] and r["v"][0] <= embedding.BATCH and r["w"] == r["v"]
        assert bytes(r["b"]) == np.asarray(r["v"], "<f4").tobytes()


def test_bytes_of_odd_vectors(spark):
    rows = spark.createDataFrame([(0, [1.5, None]), (1, []), (2, None), (3, [float("inf"), -0.0, 3.0])], "i int, v array<float>").coalesce(1)
    got = {r["i"]: r["b"] for r in rows.select("i", embedding.to_bytes("v").alias("b")).collect()}
    assert got[1] == b"" and got[2] is None and bytes(got[3]) == np.array([np.inf, -0.0, 3], "<f4").tobytes() and np.isnan(np.frombuffer(bytes(got[0]), "<f4")[1])
    blobs = spark.createDataFrame([(b"\x00\x00\x80?xyz",), (b"",), (None,)], "b binary")
    assert [r["v"] for r in blobs.select(embedding.from_bytes("b").alias("v")).collect()] == [[1.0], [], None]


def test_sections_leave_a_worker_in_parts():
    def given() -> Iterator[pd.Series]:
        yield pd.Series(["# a\n\nb"] * 1000 + [None], index=range(5, 1006))

    parts = list(markdown._sectioned(given()))
    assert sum(map(len, parts)) == 1001 and max(map(len, parts)) <= markdown.NOTES
    assert parts[0].iloc[0] == markdown.sections("# a\n\nb") and list(parts[-1])[-1] == []
    assert pa.array(parts[0].tolist()).type.num_fields == 1
