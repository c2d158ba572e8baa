"""A data source of web pages: spark.read.format("loamline_pages").option("urls", json).load().

Each host is a partition of its own, so that its calls come one after another and some time apart, however many tasks
there are; hosts are fetched side by side. URLs come with the reader's options, as a crawl's level is bounded by its pages.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.html import is_html, links_of_page, text_of
from ..functions.url_parser import absolute, parse
from .fetch import Transport, get, http_get

FORMAT = "loamline_pages"
PAGE = "url string, page_url string, content string, links array<string>, error string"
#: Seconds between the beginnings of two calls to one host, unless the option delay says otherwise.
DELAY = 0.5


@dataclass
class Host(InputPartition):
    """The URLs of one host, in their order; those that are no URL share a partition."""

    name: str
    urls: list[str]


def page_source(transport: Transport = http_get, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> type[DataSource]:
    """The source as a class whose calls go through transport."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.urls, self.delay = json.loads(options.get("urls", "[]")), float(options.get("delay", DELAY))

        def partitions(self) -> list[Host]:
            by: dict[str, list[str]] = {}
            for url in self.urls:
                found = parse(url)
                by.setdefault(found.host or "" if found else "", []).append(url)
            return [Host(name, urls) for name, urls in sorted(by.items())] or [Host("", [])]

        def read(self, host: Host) -> Iterator[tuple]:
            due = None
            for url in host.urls:
                if due is not None and (wait := due - clock()) > 0:
                    sleep(wait)
                due = clock() + self.delay
                yield self.page(url)

        def page(self, url: str) -> tuple:
            """A page as fetch_pages has it, or the error that hid it."""
            at = absolute(url, None) or url.split("#")[0].split("?")[0]
            try:
                got = get(url, transport, sleep)
            except (OSError, ValueError) as e:
                return url, at, None, [], str(e) or type(e).__name__
            body = got.body.decode(errors="replace")
            text = (text_of(body) or body) if "html" in got.content_type.lower() or is_html(body) else body
            return url, at, text, links_of_page(body, url), None

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return PAGE

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return PageSource


def read_pages(spark: SparkSession, urls: list[str], transport: Transport = http_get, delay: float = DELAY) -> DataFrame:
    """The pages of some URLs, a task for each host. The source stays registered with this transport."""
    spark.dataSource.register(page_source(transport))
    return spark.read.format(FORMAT).option("urls", json.dumps(urls)).option("delay", str(delay)).load()
