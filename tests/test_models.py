"""Word pieces against the tokenizers library; a sentence model from a tiny ONNX file against numpy."""

import hashlib

import numpy as np
import onnxruntime
import pytest
from pyspark.sql import functions as F
from tokenizers import BertWordPieceTokenizer

from loamline.engine import Engine
from loamline.functions.embedding import PASSAGE, passage_vectors, query_vector
from loamline.functions.wordpiece import WordPieces
from loamline.sources.models import SentenceModel

PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "retry", "re", "##try", "##ing", "budget", "##s", "pass", "##age", "passage", "query", ":", ",", "!", "caf", "cafe", "##e", "日", "本", "a", "##a", "##aa", "b", "-", "'", "1", "##2", "s"]
TEXTS = ["Retrying budgets, café!", "passage: retry the budgets", "日本aab", "a" * 101, "a" * 100, "aaaa b-a's 12", "", " \t ", "x​y\0re", "CAFÉ ÉÀ retrys", "b" * 30 + " " + "re " * 40]


@pytest.mark.parametrize("limit", [8, 512])
def test_word_pieces_equal_the_library(limit):
    theirs = BertWordPieceTokenizer({p: i for i, p in enumerate(PIECES)}, lowercase=True)
    theirs.enable_truncation(limit)
    assert [WordPieces(PIECES).encode(t, limit) for t in TEXTS] == [theirs.encode(t).ids for t in TEXTS]


def field(number, value):
    """A field of a protocol buffer: an integer, bytes, or a text."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def lookup_network(table, inputs):
    """An ONNX model that gives the row of table for each of input_ids."""
    shape = lambda dims: b"".join(field(1, field(2, d)) for d in dims)
    value = lambda name, kind, dims: field(1, name) + field(2, field(1, field(1, kind) + field(2, shape(dims))))
    weights = b"".join(field(1, d) for d in table.shape) + field(2, 1) + field(8, "table") + field(9, table.astype("<f4").tobytes())
    node = field(1, "table") + field(1, "input_ids") + field(2, "rows") + field(4, "Gather")
    graph = field(1, node) + field(2, "g") + field(5, weights) + b"".join(field(11, value(n, 7, ("b", "t"))) for n in inputs) + field(12, value("rows", 1, ("b", "t", "d")))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


@pytest.fixture(scope="module", params=[("input_ids",), ("input_ids", "attention_mask", "token_type_ids")])
def files(request, tmp_path_factory):
    folder, table = tmp_path_factory.mktemp("model"), np.random.default_rng(1).normal(size=(len(PIECES), 7))
    (folder / "vocab.txt").write_text("\n".join(PIECES) + "\n", encoding="utf-8")
    (folder / "model.onnx").write_bytes(lookup_network(table, request.param))
    return folder, table.astype(np.float32)


def plain_vector(table, text):
    mean = table[WordPieces(PIECES).encode(text, 512)].mean(0)
    return mean / np.linalg.norm(mean)


def test_sentence_vectors_equal_numpy(files):
    folder, table = files
    model = SentenceModel.__new__(SentenceModel)  # as a worker has it, with its session open
    model.max_ids, model._loaded = 512, (WordPieces(PIECES), onnxruntime.InferenceSession(str(folder / "model.onnx"), providers=["CPUExecutionProvider"]))
    assert np.allclose(model.embed(TEXTS), [plain_vector(table, t) for t in TEXTS], atol=1e-5)
    assert model.embed(TEXTS).dtype == np.float32


def test_sentence_model_in_the_engine(spark, tmp_path):
    folder, table = tmp_path / "model", np.random.default_rng(2).normal(size=(len(PIECES), 5)).astype(np.float32)
    folder.mkdir()
    (folder / "vocab.txt").write_text("\n".join(PIECES), encoding="utf-8")
    (folder / "model.onnx").write_bytes(lookup_network(table, ("input_ids", "attention_mask")))
    pins = {n: hashlib.sha256((folder / n).read_bytes()).hexdigest() for n in ("vocab.txt", "model.onnx")}
    with pytest.raises(ValueError, match="differ from their pins: model.onnx"):
        SentenceModel(spark, str(folder), pins | {"model.onnx": "0" * 64})
    model = SentenceModel(spark, str(folder), pins)
    texts = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "text string").repartition(3)
    got = {r["text"]: r["v"] for r in texts.select("text", passage_vectors(F.col("text"), model).alias("v")).collect()}
    assert got.pop(None) is None
    assert all(np.allclose(v, plain_vector(table, PASSAGE + t), atol=1e-5) for t, v in got.items()) and len(got) == len(TEXTS)
    engine = Engine(spark, str(tmp_path / "home"), embedder=model)
    pages = spark.createDataFrame([(i, f"https://h/{i}", t) for i, t in enumerate(["retry budgets", "aaaa b", "cafe 12"])], "page_index long, url string, content string")
    engine.add("https://h/docs", pages=pages)
    found = engine.query("aaaa b", debug=True).collect()
    best = min(found, key=lambda r: r["rank"])
    assert best["citation"] == "https://h/1" and best["vector_rank"] is not None
    assert np.allclose(query_vector("aaaa b", model), plain_vector(table, "query: aaaa b"), atol=1e-5)
