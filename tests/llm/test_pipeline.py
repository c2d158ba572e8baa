"""The pipeline's stages on a small table: what goes, what stays, and which columns come back."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

import corpus_pipeline
from loamline.llm.common import shared_dir
from loamline.llm.queries import language_model
from loamline.llm.tokens import default_tokenizer, encoder


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    tongues = {"xx": [f"{a}ach{b}en" for a in "bdgkt" for b in "mnrsl"], "yy": [f"{a}eau{b}tion" for a in "lpvfs" for b in "mnrsl"]}
    rows = []
    for i in range(60):
        lang = "xx" if i % 2 else "yy"
        rows.append((i, " ".join(rng.choice(tongues[lang]) for _ in range(80)), lang, f"s{i % 3}", 0))
    rows += [(100 + i, rows[i][1] + " dachmen", rows[i][2], "s0", 0) for i in range(5)]
    rows += [(200, None, "xx", "s1", 0), (201, "12 34", None, None, None), (202, "", "yy", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns, name
    assert sorted(r["doc_id"] for r in seen.collect()) == list(range(60))


def plain_boilerplate(docs):
    total, pages = Counter(d["source"] for d in docs), Counter()
    for d in docs:
        pages.update({(d["source"], x) for x in d["text"].split("\n") if x.split()})
    out = []
    for d in docs:
        lines = d["text"].split("\n")
        good = [x for x in lines if not x.split() or not (pages[d["source"], x] >= 3 and pages[d["source"], x] > 0.05 * total[d["source"]])]
        changed = len(good) < len(lines) and any(x.split() for x in good)
        out.append(d | ({"text": "\n".join(good), "n_chars": len("\n".join(good))} if changed else {}))
    return out


def plain_near_copies(docs):
    sets = {}
    for d in docs:
        w = d["text"].lower().split()
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if 100 * len(a & b) >= 80 * len(a | b):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return [d for d in docs if find(d["doc_id"]) == d["doc_id"]]


def plain_mix(docs):
    """Targets by filling up source after source, drawings in the order of the documents' places."""
    size = Counter()
    for d in docs:
        size[d["source"]] += len(d["text"].split())
    names = sorted(size)
    weights, goal, capped = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(size.values()), set()
    while True:
        level = (goal - sum(2 * size[s] for s in capped)) / max(1, sum(w for s, w in weights.items() if s not in capped))
        over = {s for s in names if s not in capped and weights[s] * level > 2 * size[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in names:
        target = int((2 * size[s] if s in capped else weights[s] * level) + 0.5)  # as SQL rounds, halves up
        order = sorted((d for d in docs if d["source"] == s), key=lambda d: int(hashlib.md5(f"0|{d['doc_id']}".encode()).hexdigest()[:15], 16))
        for n in (0, 1):
            left = min(target - n * size[s], size[s])
            for d in order:
                words = re.findall(r"\s*\S+", d["text"])
                if left >= len(words):
                    out.append(d)
                elif left > 0:
                    text = "".join(words[:left])
                    out.append(d | {"text": text, "n_chars": len(text)})
                left -= len(words)
    return out


def test_run_equals_plain_stages(spark, tmp_path):
    rng = random.Random(7)
    tongues = {"xx": [f"{a}ach{b}en" for a in "bdgkt" for b in "mnrsl"], "yy": [f"{a}eau{b}tion" for a in "lpvfs" for b in "mnrsl"]}
    docs = []
    for i in range(48):
        lang = "xx" if i % 2 else "yy"
        text = "\n".join(" ".join(rng.choice(tongues[lang]) for _ in range(12)) for _ in range(rng.randrange(2, 9)))
        docs.append({"doc_id": i, "text": ("dachmen site menu\n" if i % 3 == 1 else "") + text, "lang": None if i % 11 == 5 else lang, "source": "bbbcd"[i % 5], "n_chars": 0})
    docs += [docs[i] | {"doc_id": 100 + i, "text": docs[i]["text"] + " dachmen"} for i in range(6)]
    docs += [{"doc_id": 200, "text": None, "lang": "xx", "source": "b", "n_chars": 0}, {"doc_id": 201, "text": "12 34", "lang": None, "source": "c", "n_chars": 0}]
    given = spark.createDataFrame([tuple(d.values()) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    given.write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    folder = max(Path(shared_dir(spark).removeprefix("file:")).glob("corpus-pipeline-*"), key=lambda p: p.stat().st_mtime)
    seen = lambda k: Counter(tuple(r) for r in spark.read.parquet(str(folder / str(k))).select(*given.columns).collect())
    rows = lambda ds: Counter(tuple(d.values()) for d in ds)

    model, want = language_model(given), []
    for d in docs:
        (name,), (score,), _ = model.predict([d["text"]])
        if name != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            want.append(d | {"lang": d["lang"] or name})
    assert len(want) == 54 and seen(0) == rows(want)
    for k, plain in enumerate((plain_boilerplate, plain_near_copies, plain_mix), 1):
        before, want = want, plain(want)
        assert rows(want) != rows(before) and seen(k) == rows(want), plain.__name__

    ids, found, filled = encoder(default_tokenizer()), defaultdict(Counter), Counter()
    for d in want:
        found[d["doc_id"]].update([*ids.ids(d["text"]).tolist(), 1])
    got = defaultdict(Counter)
    for p in pieces:
        got[p["doc_id"]].update(np.frombuffer(p["ids"], "<u4").tolist())
        filled[p["sequence_id"]] += p["length"]
    assert got == found
    assert all(n == 2048 or n & (n - 1) == 0 for n in filled.values())
