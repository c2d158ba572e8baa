"""Each operator against a plain version on a small table of odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import exact_dedup, jaccard_join, language_id, line_dedup, mixing, packing, quality_classifier, quality_rules, subword, toxicity
from loamline.llm.components import components
from loamline.llm.token_counts import CHANGES, TokenRollup, count_tokens
from loamline.llm.tokens import default_tokenizer, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lm_text string, sig string, n_words string"


def rows(texts, start=0):
    return [(start + i, t, ["en", None][i % 5 == 4], ["a", "b", None][i % 3], 0, "clash", "clash", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    out = [None, "", "   ", "one", "One", "ONE", "é È", "a b c", "x" * 5000, "the same line\nother\nthe same line", "12 34 !!"]
    base = " ".join(rng.choice(words) for _ in range(120))
    for _ in range(12):
        w = base.split()
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += ["\n".join(["home page menu", *(f"{s} line {rng.randrange(9)}" for s in "xyz")]) for _ in range(10)]
    return out + [" ".join(rng.choice(words) for _ in range(20_000))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts) + rows(texts[3:6], 3) + [(None, "one", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").encode().lower()


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    plain = defaultdict(list)
    given = docs.select("doc_id", "text").collect()
    for r in given:
        plain[lower(r["text"])].append(r["doc_id"])
    want = Counter()
    for r in given:
        group = plain[lower(r["text"])]
        keep = max((x for x in group if x is not None), default=None)
        want[(r["doc_id"], keep, len(group), r["doc_id"] == keep)] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.normalised_sha256(F.lit("AÉ")) is not None


def test_quality_counts(docs, empty):
    for r in quality_rules.with_counts(docs).collect():
        t = r["text"] or ""
        w = [x.decode() for x in t.encode().split()]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["lm_text"] in ("clash", None)
    assert quality_rules.quality_rules(quality_rules.with_counts(empty), quality_rules.default_rules(counted=True)).count() == 0


def test_cascade_order_changes_no_verdict(docs):
    rules = quality_rules.default_rules()
    a = docs.select("text", quality_rules.cascade(rules).isNull().alias("kept"))
    ordered = quality_rules.estimate(docs, rules, [F.col("doc_id")])
    b = docs.select("text", quality_rules.cascade(ordered[::-1]).isNull().alias("kept"))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert [r.name for r in ordered] == [r.name for r in quality_rules.estimate(docs.repartition(3), rules[::-1], [F.col("doc_id")])]
    assert all(x.worth > y.worth or (x.worth == y.worth and x.cost <= y.cost) for x, y in zip(ordered, ordered[1:], strict=False))
    judged = quality_rules.quality_rules(docs, out_col="lm_text", skip=F.lit(True))
    assert judged.columns == docs.columns and judged.filter("lm_text IS NOT NULL").count() == 0


def test_cascade_asks_the_best_rule_first(docs):
    dear = quality_rules.Rule("dear", F.lit(True), F.lit(100.0))
    cheap = quality_rules.Rule("cheap", F.lit(True), F.lit(10.0))
    never = quality_rules.Rule("never", F.lit(False), F.lit(1.0))
    assert [r.name for r in quality_rules.estimate(docs, [dear, never, cheap], [F.col("text")])] == ["cheap", "dear", "never"]
    assert {r["rejected_by"] for r in quality_rules.quality_rules(docs, [dear, never, cheap]).collect()} == {"cheap"}


@pytest.mark.parametrize("limit, whole, hot", [(0, False, 1000), (0, True, 2), (100_000, True, 1000), (100_000, False, 1000)])
def test_line_dedup(docs, empty, limit, whole, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", hot)
    given = docs.collect()
    total, pages = Counter(r["source"] for r in given), Counter()
    for r in given:
        pages.update({(r["source"], x) for x in (r["text"] or "").split("\n") if x.encode().split()})
    want = Counter()
    for r in given:
        lines = r["text"].split("\n") if r["text"] is not None else []
        good = [x for x in lines if not x.encode().split() or not (pages[r["source"], x] >= 3 and pages[r["source"], x] > 0.1 * total[r["source"]])]
        cut = r["text"] is not None and (not whole or any(x.encode().split() for x in good))
        want[(r["doc_id"], "\n".join(good) if cut else r["text"], len(lines), len(lines) - len(good) if cut else 0)] += 1
    got = line_dedup.line_dedup(docs, max_ratio=0.1, keep_whole=whole, broadcast_rows=limit)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == want
    assert any(n for *_, n in want)
    assert line_dedup.line_dedup(empty).count() == 0


@pytest.mark.parametrize("limit", [0, 100_000])
def test_mixing(docs, empty, limit):
    got = mixing.mix(docs, broadcast_rows=limit).collect()
    assert len(got) == docs.count()
    size, taken = Counter(), Counter()
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] == sum(d["words"] for d in r["draws"]) <= 2 * r["size"]
    weights, goal = {"a": 3, "b": 1, None: 2}, 1.5 * sum(size.values())
    capped = set()
    while True:
        left = goal - sum(2 * size[s] for s in capped)
        level = left / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s, w in weights.items() if s not in capped and w * level > 2 * size[s]}
        if not over:
            break
        capped |= over
    for r in got:
        want = 2 * size[r["source"]] if r["source"] in capped else weights[r["source"]] * level
        assert r["target"] == pytest.approx(want) and r["source_size"] == size[r["source"]]
    for s in size:
        assert abs(taken[s] - next(r["target"] for r in got if r["source"] == s)) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, broadcast_rows=limit).collect()))
    assert mixing.mix(empty).count() == 0


def test_splitting_tree_deals_every_block_once(spark):
    quotas = spark.createDataFrame([(0, 70), (1, 3), (2, 0), (3, 41)], "source_rank int, n long")
    leaves = mixing.shard_quotas(quotas, 8, seed=3).collect()
    total = Counter()
    for r in leaves:
        total[r["source_rank"]] += r["n"]
    assert total == Counter({0: 70, 1: 3, 3: 41})
    by_shard = Counter()
    for r in leaves:
        by_shard[r["shard"]] += r["n"]
    assert max(by_shard.values()) - min(by_shard.values()) <= 2


def test_token_ids_are_those_of_the_tokenizers_library(texts):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(default_tokenizer()), encoder(default_tokenizer())
    for t in [*texts, "<|endoftext|> a", "日本語 🙂", "\r\n \t x" + " " * 3000, "it's 1½"]:
        assert fast.ids(t).tolist() == (slow.encode(t, add_special_tokens=False).ids if t else [])


def test_packing_is_an_exact_round_trip(docs, empty):
    pieces = packing.pack(docs).collect()
    fast, whole = encoder(default_tokenizer()), defaultdict(list)
    for r in docs.collect():
        whole[r["doc_id"]].append(np.append(fast.ids(r["text"]), 1).tolist())
    found, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"]
        found[p["doc_id"]].append((p["start"], ids))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc, parts in found.items():
        assert sorted(x for _, ids in parts for x in ids) == sorted(x for ids in whole[doc] for x in ids)
        if len(whole[doc]) == 1:
            assert [x for _, ids in sorted(parts) for x in ids] == whole[doc][0]
    assert sum(p["length"] for p in pieces) == sum(len(i) for v in whole.values() for i in v)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(empty).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = grid[np.argsort(packing.hilbert_key(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_rollup_follows_signed_batches_and_ignores_replays(spark, tmp_path):
    change = lambda *r: spark.createDataFrame(list(r), CHANGES)
    roll = TokenRollup(spark, str(tmp_path / "r"))
    first = change(("insert", "a", "en", "v1", 10, None, None, None, None), ("insert", None, None, "v1", 5, None, None, None, None), ("insert", "b", "en", "v1", None, None, None, None, None))
    assert roll.apply("1", first) and not roll.apply("1", first)
    assert roll.apply("2", change(("revise", "a", "en", "v2", 12, "a", "en", "v1", 10), ("delete", None, None, None, None, None, None, "v1", 5)))
    want = {("a", "en", "v2", 1, 12), ("b", "en", "v1", 1, 0)}
    assert {tuple(r) for r in roll.totals().collect()} == want
    assert roll.compact() and not roll.apply("2", first)
    assert {tuple(r) for r in roll.totals().collect()} == want
    assert roll.apply("3", change()) and TokenRollup(spark, str(tmp_path / "none")).totals().count() == 0
    with pytest.raises(Exception, match="unknown op"):
        roll.apply("4", change(("move", "a", "en", "v1", 1, None, None, None, None)))


def test_rollup_keeps_what_other_writers_commit_meanwhile(spark, tmp_path):
    row = lambda n: spark.createDataFrame([("insert", "a", "en", "v1", n, None, None, None, None)], CHANGES)
    roll, other = TokenRollup(spark, str(tmp_path / "r")), TokenRollup(spark, str(tmp_path / "r"))
    assert roll.apply("1", row(10))
    known = roll._state
    late = known()
    assert other.apply("2", row(5)) and other.compact()
    roll._state = lambda: late  # a writer that looked before the other one committed
    assert not roll.compact() and not roll.apply("2", row(5))
    roll._state = known
    assert roll.apply("compact-0", row(1)) and roll.apply("commits/1", row(-1)) and roll.batches() == ["1", "2", "commits/1", "compact-0"]
    assert roll.apply("undo", spark.createDataFrame([("delete", None, None, None, None, "a", "en", "v1", n) for n in (1, -1)], CHANGES))
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "v1", 2, 15)]
    assert roll.compact() and [tuple(r) for r in other.totals().collect()] == [("a", "en", "v1", 2, 15)]


def test_token_counts(docs, empty):
    fast = encoder(default_tokenizer())
    for r in count_tokens(docs, keep=("text",)).collect():
        assert r["tokens"] == len(fast.ids(r["text"])) and r["n_bytes"] == len((r["text"] or "").encode())
    assert count_tokens(empty).count() == 0


def shingle_set(t, size):
    w = lower(t).split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("size, threshold, limit", [(4, 85, 100_000), (5, 80, 0)])
def test_jaccard_join(docs, empty, size, threshold, limit):
    given = [(r["doc_id"], shingle_set(r["text"], size)) for r in docs.collect() if r["doc_id"] is not None]
    root = {i: i for i, _ in given}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in given:
        for j, b in given:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    got = jaccard_join.jaccard_join(docs, words=size, threshold=threshold, broadcast_rows=limit).filter("doc_id IS NOT NULL").collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((i, len(s), find(i)) for i, s in given)
    kept = jaccard_join.deduplicated(docs, words=size, threshold=threshold, broadcast_rows=limit)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == Counter({find(i) for i, _ in given})
    assert jaccard_join.jaccard_join(empty).count() == 0 and jaccard_join.deduplicated(empty).count() == 0


def test_similar_sets_share_a_signature_and_pass_the_bounds():
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, 6, 7, 8, 13, 40, 150, 1100]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            gone = rng.integers(0, max(1, jaccard_join.furthest(n, n, 80)) + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, rng.integers(0, gone + 1)).astype(np.uint64)]))
            if not len(b) or not jaccard_join.sets_near(a.tobytes(), b.tobytes(), 80):
                continue
            assert set(jaccard_join.signatures(a, 80)) & set(jaccard_join.signatures(b, 80))
            assert jaccard_join.sketches_near(jaccard_join.long_sketch(a), jaccard_join.long_sketch(b), 80)
            bits = np.unpackbits((jaccard_join.sketch(a) ^ jaccard_join.sketch(b)).view(np.uint8)).sum()
            assert bits <= jaccard_join.furthest(len(a), len(b), 80)


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    links = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (None, 1), (1, 2)]
    got = components(spark.createDataFrame(links, "u long, v long"), small)
    assert {tuple(r) for r in got.collect()} == {(2, 1), (3, 1), (6, 5), (7, 5), (8, 5), (9, 5)}
    assert components(spark.createDataFrame([], "u long, v long"), small).count() == 0


def made_text(rng, words, n=60):
    return ". ".join(" ".join(rng.choice(words) for _ in range(10)).capitalize() for _ in range(n // 10)) + "."


def test_quality_model_learns_and_scores_alike(docs, empty):
    rng = random.Random(2)
    good, bad = [f"good{i}ly" for i in range(40)], [f"BAD{i}!!" for i in range(40)]
    sample = [(made_text(rng, bad if i % 3 == 0 else good).encode(), int(i % 3 != 0)) for i in range(120)]
    model = quality_classifier.train(sample)
    held = [(made_text(rng, bad if i % 2 else good).encode(), int(i % 2 == 0)) for i in range(40)]
    assert [int(s >= 0.3) for s in model.scores([t for t, _ in held])] == [y for _, y in held]
    at, share = quality_classifier.features(held[0][0])
    assert model.scores([held[0][0]])[0] == pytest.approx(1 / (1 + np.exp(-(model.weights[at] @ share + model.bias))))
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.score(empty, model).count() == 0
    assert quality_classifier.train([]).scores([b"x", None]).tolist() == [0.5, 0.5]


def test_toxicity_finds_the_sentence(docs, empty):
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(80)]

    def text(toxic):
        s = [" ".join(rng.choice(plain) for _ in range(9)) + "." for _ in range(6)]
        if toxic:
            s[rng.randrange(6)] = " ".join(rng.choice(plain) for _ in range(7)) + f" vile{rng.choice('abc')} one."
        return " ".join(s).encode()

    model = toxicity.train([(text(i % 3 == 0), int(i % 3 == 0)) for i in range(240)])
    for i in range(30):
        t = text(i % 2)
        each = model.sentences(t)
        assert (model.score(each) >= 0.7) == bool(i % 2)
        if i % 2:
            (start, length), *more = toxicity.locate(t, np.flatnonzero(each >= 0.5))
            assert b"vile" in t[start : start + length] and not more
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train([]).sentences(b"a b.").shape == (1,)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    e, m, s = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 2])
    p, _ = language_id.forward_backward(e, m, s, lengths)
    q = language_id.marginals_only(e.transpose(1, 0, 2), m, s, lengths).transpose(1, 0, 2)
    for c, n in enumerate(lengths):
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            score = np.exp(s[path[0]] + sum(e[c, i, y] for i, y in enumerate(path)) + sum(m[a, b] for a, b in zip(path, path[1:], strict=False)))
            for i, y in enumerate(path):
                want[i, y] += score
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(p[c, :n], want) and np.allclose(q[c, :n], want)


def test_language_id(docs, empty):
    rng = random.Random(4)
    tongues = {"xx": [f"{a}ach{b}en" for a in "bdg" for b in "mnr"], "yy": [f"{a}eau{b}tion" for a in "lpv" for b in "mnr"]}
    sample = [(made_text(rng, tongues[k]).encode(), k) for i in range(60) for k in tongues]
    model = language_id.train(sample, max_batches=20)
    given = [made_text(rng, tongues["yy"]), made_text(rng, tongues["xx"]), None, "12 !", made_text(rng, tongues["xx"], 3000) + " leautionm" * 2, "½ ² ①_٣"]
    names, scores, spans = model.predict(given)
    assert names == ["yy", "xx", "und", "und", "xx", "und"] and [*scores[2:4], scores[5]] == [0.0, 0.0, 0.0] and min(scores[:2]) > 0.9
    assert spans[:4] == [[(0, 60, "yy")], [(0, 60, "xx")], [], []] and spans[4][0] == (0, 3000, "xx")
    switched = [made_text(rng, tongues["xx"], 150) + " " + made_text(rng, tongues["yy"], 300), "", made_text(rng, tongues["yy"], 20) + " " + made_text(rng, tongues["xx"], 40)]
    assert model.predict(switched)[2] == [[(0, 150, "xx"), (150, 300, "yy")], [], [(0, 20, "yy"), (20, 40, "xx")]]
    assert language_id.words_of("x²y ½ Ab_c9d") == ["x", "y", "ab", "c", "d"]
    got = language_id.identify(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (not language_id.words_of(r["text"])) for r in got)
    assert language_id.identify(empty, model).count() == 0
    assert language_id.train([]).predict(["a"]) == (["und"], [0.0], [[]])


def test_word_hashes_do_not_depend_on_the_batch():
    words = [b"a", b"", b"word", "é".encode(), b"x" * 300]
    together = subword.word_hashes(words)
    assert [subword.word_hashes([w])[0] for w in words] == list(together) and len(set(together)) == 5
    table = subword.WordTable(lambda w: [subword.word_hashes(w)], max_words=6)
    for _ in range(3):
        for batch in (words, [b"other", b"a", b"third"], words[::-1]):
            at = table.rows(batch)
            assert table.columns[0][at].tolist() == subword.word_hashes(batch).tolist()


def test_digest():
    assert hashlib.sha256(lower("AÉ")).hexdigest() == hashlib.sha256("aÉ".encode()).hexdigest()
    assert zlib.crc32(b"") == 0
