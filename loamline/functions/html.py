"""HTML to text and links, from the standard's tree, in Arrow batches; no built-in function parses HTML."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .html_tree import body_of, parse
from .url_parser import absolute


def text_of(html: str) -> str:
    body = body_of(parse(html))
    return "".join(f"{x}\n" for x in body.texts()) if body else ""


def links_of(html: str) -> list[str]:
    return [n.attributes["href"] for n in parse(html).elements() if n.tag == "a" and "href" in n.attributes]


def _texts(html: pd.Series) -> pd.Series:
    return html.map(lambda h: text_of(h or "") or h)


def html_to_text(html: Column) -> Column:
    """The body's text nodes, trimmed, one a line; the raw HTML where there are none."""
    return F.pandas_udf(_texts, "string")(html)


def _absolute(targets: list[str], base: str | None) -> list[str]:
    return [u for t in targets if (u := absolute(t, base)) is not None]


def _targets(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([_absolute(links_of(h or ""), b) for h, b in zip(html, base, strict=True)])


def html_links(html: Column, base: Column) -> Column:
    """The targets of all a[href] as canonical URLs, in order."""
    return F.pandas_udf(_targets, "array<string>")(html, base)


def looks_like_html(x: Column) -> Column:
    start = F.regexp_replace(x, r"(?U)^\s+", "")
    return F.startswith(start, F.lit("<!DOCTYPE html")) | F.startswith(start, F.lit("<html")) | x.contains("<body") | x.contains("<main") | x.contains("<article")


def targets_of(text: str) -> list[str]:
    """What a text links to: Markdown targets, then bare URLs, in order."""
    bare = (w.strip("\"'()[]<>,.") for w in re.split(r"[ \t-\r]+", text))
    return [t.strip(" ") for t in re.findall(r"\]\(([^)]*)\)", text)] + [w for w in bare if w.startswith(("http://", "https://"))]


def _text_targets(text: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([_absolute(targets_of(t or ""), b) for t, b in zip(text, base, strict=True)])


def text_links(x: Column, base: Column) -> Column:
    """Markdown targets, then bare URLs, in order, as canonical URLs."""
    return F.pandas_udf(_text_targets, "array<string>")(x, base)


def is_html(body: str) -> bool:
    """looks_like_html of one text."""
    return body.lstrip().startswith(("<!DOCTYPE html", "<html")) or any(t in body for t in ("<body", "<main", "<article"))


def links_of_page(body: str, base: str) -> list[str]:
    """page_links of one page."""
    return list(dict.fromkeys(_absolute([*links_of(body), *targets_of(body)], base)))


def page_links(body: Column, base: Column) -> Column:
    """The canonical URLs that a raw body links to, of elements and of text, first occurrences."""
    return F.array_distinct(F.concat(html_links(body, base), text_links(body, base)))
