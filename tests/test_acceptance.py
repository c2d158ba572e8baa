"""Made sites, crawled and asked through the engine, without and with noise."""

from loamline.engine import Engine
from loamline.functions.embedding import HashingEmbedder
from loamline.operators.evaluation import case_summary
from loamline.plans.acceptance import acceptance

CASES = [
    ("c1", "Job_Queue", "guide/retry.html", "https://s.example/1", "How does the retry budget work?", "Retry budgets", "# Retry budget\n\nA worker spends its retry budget before it gives up.", ["retry budget", "gives up"]),
    ("c2", "Job_Queue", "guide/leases.html", None, "When do leases expire?", None, "Leases expire after thirty seconds unless a heartbeat renews them.", ["thirty seconds", "heartbeat"]),
    ("c3", "Job_Queue", "api.html", "https://s.example/3", "What is the flag MAX_INFLIGHT for?", "Flags", "Set MAX_INFLIGHT to bound what is <running> at once.", ["MAX_INFLIGHT", "<running>"]),
]


def test_cases_pass_small_and_large(spark, tmp_path):
    cases = spark.createDataFrame(CASES, "id string, library string, doc_path string, source_url string, question string, llms_summary string, doc_text string, must_include array<string>")
    engine = lambda mode, transport: Engine(spark, str(tmp_path / mode), transport=transport, embedder=HashingEmbedder(64))
    judged = acceptance(cases, engine, {"small": 0, "large": 5}).cache()
    assert [(r["mode"], r["id"], r["missing_terms"]) for r in judged.collect() if not r["passed"]] == []
    found = {r["mode"]: r for r in case_summary(judged).collect()}
    assert {m: (r["cases"], r["passed"], r["hybrid"]) for m, r in found.items()} == {"small": (3, 3, 3), "large": (3, 3, 3)}
