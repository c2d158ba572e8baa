"""Research papers: what a registry's page says of one, its text, and the header it is indexed under."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .html_tree import Node, parse

PAPER = "struct<title:string,abstract:string,authors:array<string>,date:string,pdf_url:string,page_url:string>"
#: Places to look for a paper's text, the best first.
PLACES = ["article.ltx_document", "main article", "article", "main", "body"]


def _metas(html: str) -> dict[tuple[str, str], list[str]]:
    """The contents of meta tags by name and by property, blank ones left out."""
    found: dict[tuple[str, str], list[str]] = {}
    for node in parse(html).elements():
        value = node.attributes.get("content", "").strip()
        if node.tag == "meta" and value:
            for kind in ("name", "property"):
                if node.attributes.get(kind):
                    found.setdefault((kind, node.attributes[kind]), []).append(value)
    return found


def paper_of(html: str | None) -> dict | None:
    """A page's metadata; None where it names no title or no abstract."""
    metas = _metas(html or "")
    first = lambda *keys: next((metas[k][0] for k in keys if k in metas), None)
    title = first(("name", "citation_title"), ("property", "og:title"))
    abstract = first(("name", "citation_abstract"), ("property", "og:description"))
    if title is None or abstract is None:
        return None
    rest = {k: first(("name", f"citation_{k}")) for k in ("date", "pdf_url")}
    return {"title": title, "abstract": abstract, "authors": metas.get(("name", "citation_author"), []), **rest, "page_url": first(("property", "og:url"))}


def _is(place: str, node: Node) -> bool:
    if place == "article.ltx_document":
        return node.tag == "article" and "ltx_document" in node.attributes.get("class", "").split()
    if place == "main article":
        return node.tag == "article" and node.within("main")
    return node.tag == place


def full_text(html: str | None) -> str | None:
    """The text of the first element at the first of PLACES that has any, a text node a line; None where none has."""
    nodes = list(parse(html or "").elements())
    texts = (found.texts() for p in PLACES if (found := next((n for n in nodes if _is(p, n)), None)))
    return next(("\n".join(t) for t in texts if t), None)


def _papers(html: pd.Series) -> pd.DataFrame:
    rows = [paper_of(h) or {} for h in html]
    return pd.DataFrame({k: [r.get(k) for r in rows] for k in ("title", "abstract", "authors", "date", "pdf_url", "page_url")})


def paper_metadata(html: Column) -> Column:
    """A struct of PAPER; all its fields are null where the page is no paper's."""
    return F.pandas_udf(_papers, PAPER)(html)


def _full_texts(html: pd.Series) -> pd.Series:
    return html.map(full_text)


def paper_text(html: Column) -> Column:
    return F.pandas_udf(_full_texts, "string")(html)


def paper_version(x: Column) -> Column:
    """The version at the end of a paper's id or URL, as v2; null where there is none."""
    bare = F.regexp_replace(F.regexp_replace(x, r"(\.pdf)+$", ""), "/+$", "")
    return F.nullif(F.regexp_extract(bare, "(v[0-9]+)$", 1), F.lit(""))


def paper_header(paper_id: Column, version: Column, paper: Column) -> Column:
    """The text a paper is indexed under; lines that nothing is known for are left out."""
    line = lambda name, value: F.concat(F.lit(f"\n{name}: "), value)
    authors = F.when(F.size(paper["authors"]) > 0, F.array_join(paper["authors"], ", "))
    parts = [line("ID", paper_id), line("Version", version), line("Title", paper["title"]), line("Authors", authors), line("Date", paper["date"]), line("PDF", paper["pdf_url"])]
    return F.concat_ws("", F.lit("Research paper\n\nRegistry: arXiv"), *parts, F.lit("\n\nAbstract:\n"), paper["abstract"])
