"""The acceptance run: made sites are crawled into a store, and every case's question is asked through the engine.

Once over the cases' pages alone (small), once with noise pages beside them (large). The number of cases is small by
nature: each is one question of a user, and the driver asks them one after another.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import evaluation
from ..sources.fetch import Response, Transport

ORIGIN = "https://bench.example"
MODES = {"small": 0, "large": 64}
RAN = "mode string, id string, must_include array<string>, output string, exit_code int, elapsed_s double"


def served(site: DataFrame) -> Transport:
    """A transport that answers with a made site (path, body), which the driver holds."""
    pages = {f"{ORIGIN}/{r['path']}": r["body"] for r in site.collect()}
    pages |= {u.removesuffix("index.html"): b for u, b in pages.items() if u.endswith("/index.html")}

    def answer(url: str) -> Response:
        body = pages.get(url)
        return Response(404, b"") if body is None else Response(200, body.encode(), "text/plain" if url.endswith(".txt") else "text/html")

    return answer


def ask(engine: Engine, case: dict, mode: str) -> tuple:
    """A case's row of RAN: what the evidence for its question says, and how long it took."""
    began = time.perf_counter()
    try:
        rows = engine.query(case["question"], label=case["library"], debug=True).orderBy("rank", "chunk_index").collect()
        hybrid = "rrf_hybrid" if any(r["vector_rank"] is not None for r in rows) else "lexical"
        said = "\n".join([hybrid, *(f"{r['citation']}\n{r['content']}\nsource_prior: {r['debug']['source_prior']}" for r in rows)])
        code = 0
    except (LookupError, ValueError) as e:
        said, code = str(e), 1
    return mode, case["id"], case["must_include"], said, code, time.perf_counter() - began


def acceptance(cases: DataFrame, engine_for: Callable[[str, Transport], Engine], modes: dict[str, int] = MODES) -> DataFrame:
    """The judged cases (evaluation.judged) of each mode, a mode's name to its number of noise pages a library.

    engine_for makes an engine with an empty store for a mode, over a transport.
    """
    given, out = [r.asDict() for r in cases.collect()], []
    slugs = {r["library"]: r["slug"] for r in evaluation.libraries(cases).select("library", evaluation.slug_of(F.col("library")).alias("slug")).collect()}
    for mode, noise in modes.items():
        engine = engine_for(mode, served(evaluation.bench_site(cases, noise)))
        for library, slug in sorted(slugs.items()):
            engine.add(f"{ORIGIN}/{slug}/", label=library)
        out += [ask(engine, case, mode) for case in given]
    return evaluation.judged(cases.sparkSession.createDataFrame(out, RAN))
