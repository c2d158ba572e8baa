"""URL rules as Columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower
from .url_parser import parse

#: Suffixes of paths that are assets, not documents.
ASSETS = "png jpg jpeg gif webp svg ico css js mjs map pdf zip tar gz mp4 webm woff woff2 ttf".split()


PARSED = "struct<scheme:string,host:string,port:int,path:string,bare:string>"


def _parse(url: pd.Series) -> pd.DataFrame:
    found = [None if u is None else parse(u) for u in url]
    rows = [(None,) * 5 if p is None else (p.scheme, p.host, p.effective_port(), p.path or "/", p.bare()) for p in found]
    out = pd.DataFrame(rows, columns=["scheme", "host", "port", "path", "bare"])
    return out.astype({"port": "Int32"})


def parsed(url: Column) -> Column:
    """scheme, host, effective port, path and the URL without query and fragment; nulls where it is no absolute URL.

    Every rule reads these, and equal calls in one step are one call.
    """
    return F.pandas_udf(_parse, PARSED)(url)


def canonical_url(url: Column) -> Column:
    """As the URL standard writes it, without query and fragment; what is no absolute URL loses those alone."""
    return F.coalesce(parsed(url).bare, F.regexp_replace(url, r"[?#].*$", ""))


def scheme(url: Column) -> Column:
    return F.coalesce(parsed(url).scheme, F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(parsed(url).host, F.lit(""))


def port(url: Column) -> Column:
    return parsed(url).port


def path(url: Column) -> Column:
    return F.coalesce(parsed(url).path, F.lit("/"))


def is_asset(url: Column) -> Column:
    return ascii_lower(path(url)).rlike(r"\.(" + "|".join(ASSETS) + ")$")


def same_origin(a: Column, b: Column) -> Column:
    """Whether both are absolute URLs of one scheme, host and port."""
    p, q = parsed(a), parsed(b)
    return F.coalesce((p.scheme == q.scheme) & p.host.eqNullSafe(q.host) & p.port.eqNullSafe(q.port), F.lit(False))


def in_scope(seed: Column, candidate: Column) -> Column:
    """Whether a crawl from seed may visit candidate: same origin, below the seed's path, no asset."""
    root = F.concat(F.regexp_replace(path(seed), "/+$", ""), F.lit("/"))
    below = F.startswith(path(candidate), root) | (path(candidate) == F.regexp_replace(root, "(?<=.)/$", ""))
    return same_origin(seed, candidate) & below & ~is_asset(candidate)


def is_llms_txt(url: Column) -> Column:
    return F.endswith(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), F.lit("/llms.txt"))


def llms_candidates(seed: Column) -> Column:
    """Where a site's llms.txt may be: below the seed, beside it, at the origin; an llms.txt seed is its own."""
    bare = canonical_url(seed)
    origin = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    below = F.concat(F.regexp_replace(bare, "/+$", ""), F.lit("/llms.txt"))
    beside = F.concat(F.regexp_replace(bare, "[^/]*$", ""), F.lit("llms.txt"))
    return F.when(is_llms_txt(seed), F.array(bare)).otherwise(F.array_distinct(F.array(below, beside, F.concat(origin, F.lit("/llms.txt")))))


def default_label(url: Column) -> Column:
    return F.translate(F.regexp_replace(host(url), r"^www\.", ""), ".:", "--")


def arxiv_id(url: Column) -> Column:
    """The paper's id from an abs, pdf or html path; empty if there is none."""
    raw = F.regexp_extract(path(url), r"^/(?:abs|html|pdf)/([A-Za-z0-9.\-/_]+)$", 1)
    return F.when(F.startswith(path(url), F.lit("/pdf/")), F.regexp_replace(raw, r"\.pdf$", "")).otherwise(raw)


def input_kind(url: Column) -> Column:
    """source, research_paper, docs or notes; null for what can't be added."""
    web = scheme(url).isin("http", "https")
    repository = path(url).rlike("^/[^/]+/[^/]+")
    return (
        F.when(web & (host(url) == "github.com"), F.when(repository, F.lit("source")))
        .when(web & host(url).isin("arxiv.org", "www.arxiv.org"), F.when(arxiv_id(url) != "", F.lit("research_paper")))
        .when(web, F.lit("docs"))
        .when(scheme(url) == "file", F.lit("notes"))
    )


def in_llms_scope(llms: Column, candidate: Column) -> Column:
    """Whether a link of an llms.txt may be visited: same origin, below the folder it lies in, no asset."""
    folder = F.concat(F.regexp_replace(path(llms), "/+[^/]*$", ""), F.lit("/"))
    return same_origin(llms, candidate) & F.startswith(path(candidate), folder) & ~is_asset(candidate)


def default_name(url: Column) -> Column:
    """The label of an input by its kind: repository, paper, file or host."""
    kind = input_kind(url)
    last = F.regexp_extract(path(url), "([^/]+)/*$", 1)
    repository = F.regexp_replace(F.regexp_extract(path(url), "^/[^/]+/([^/]+)", 1), r"\.git$", "")
    return (
        F.when(kind == "source", repository)
        .when(kind == "research_paper", F.concat(F.lit("arxiv-"), F.translate(arxiv_id(url), "/", "-")))
        .when(kind == "notes", F.regexp_replace(last, r"(?<=.)\.[^.]*$", ""))
        .otherwise(default_label(url))
    )


def retry_seconds(retry_after: Column, attempt: Column) -> Column:
    """How long to wait after a 429 or 503: what the server asks for, else half a second doubled each time; 10 at most."""
    asked = F.when(retry_after.rlike("^[0-9]+$"), F.coalesce(retry_after.try_cast("double"), F.lit(10.0)))
    return F.least(F.coalesce(asked, F.lit(0.5) * F.pow(F.lit(2.0), attempt)), F.lit(10.0))
