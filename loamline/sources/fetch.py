"""Fetching pages on the executors, with retries, a cap on bodies, and a transport that tests replace."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..functions.arrow import bounded_batches
from ..functions.urls import canonical_url

#: Fixed values of the fetch contract: seconds, attempts, bytes.
TIMEOUT, ATTEMPTS, FIRST_DELAY, LONGEST_DELAY, MAX_BODY = 20, 3, 0.5, 10.0, 5 * 1024 * 1024
BUSY = (429, 503)
AGENT = "loamline (docs indexer)"


@dataclass(frozen=True)
class Response:
    status: int
    body: bytes
    content_type: str = ""
    retry_after: str | None = None


Transport = Callable[[str], Response]


def http_get(url: str) -> Response:
    """One GET; no more than a byte over MAX_BODY is read."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as got:
            return Response(got.status, got.read(MAX_BODY + 1), got.headers.get("Content-Type", ""), got.headers.get("Retry-After"))
    except urllib.error.HTTPError as e:
        return Response(e.code, b"", "", e.headers.get("Retry-After") if e.headers else None)


def wait_seconds(retry_after: str | None, fallback: float) -> float:
    asked = float(retry_after) if retry_after and retry_after.isascii() and retry_after.isdigit() else fallback
    return min(asked, LONGEST_DELAY)


def get(url: str, transport: Transport = http_get, sleep: Callable[[float], None] = time.sleep) -> Response:
    """The response to url, tried again while the server is busy; OSError where it fails or its body is too large."""
    for attempt in range(ATTEMPTS):
        got = transport(url)
        if got.status not in BUSY or attempt == ATTEMPTS - 1:
            break
        sleep(wait_seconds(got.retry_after, FIRST_DELAY * 2**attempt))
    if not 200 <= got.status < 300:
        raise OSError(f"status {got.status}")
    if len(got.body) > MAX_BODY:
        raise OSError("body too large")
    return got


def fetch_bodies(urls: DataFrame, transport: Transport = http_get) -> DataFrame:
    """url, content_type, body and error of every row of urls (column url); a failure is a row with its error."""
    bounded_batches(urls.sparkSession, 16)

    def one(url: str) -> tuple:
        try:
            got = get(url, transport)
        except (OSError, ValueError) as e:
            return url, None, None, str(e) or type(e).__name__
        return url, got.content_type.lower(), got.body.decode(errors="replace"), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(u) for u in batch["url"]], columns=["url", "content_type", "body", "error"], dtype=object)

    return urls.select("url").filter("url IS NOT NULL").mapInPandas(run, "url string, content_type string, body string, error string")


def fetch_pages(urls: DataFrame, transport: Transport = http_get, tasks: int = 16) -> DataFrame:
    """url, page_url, content, links and error: bodies as text, with the links of the raw bodies, first occurrences."""
    got = fetch_bodies(urls.repartition(tasks, "url"), transport)
    body = F.coalesce("body", F.lit(""))
    is_html = F.contains("content_type", F.lit("html")) | html.looks_like_html(body)
    links = html.page_links(body, F.col("url"))
    text = html.html_to_text(body)
    return got.select("url", canonical_url(F.col("url")).alias("page_url"), F.when(is_html, text).otherwise(F.col("body")).alias("content"), links.alias("links"), "error")
