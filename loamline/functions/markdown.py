"""Markdown sections and their plain text, from the blocks and inline text of CommonMark."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .commonmark import Block, Document, inline, parse

SECTION = "struct<section_index:int,heading_path:array<string>,level:int,parent:int,previous:int,next:int,anchor:string,markdown:string,plain_text:string,content_hash:string>"
#: Documents whose sections a worker holds at once, as Python objects.
NOTES = 64
_TASK = re.compile(r"\[[ xX]\](?=\s)")


def _texts(block: Block, found: Document) -> list[str]:
    """The pieces of text that a block shows."""
    if block.kind == "code":
        return block.texts
    if block.kind == "row":
        return [piece for cell in block.texts for piece in inline(cell, found.labels)]
    text = "\n".join(block.texts)
    return inline(_TASK.sub("", text, count=1) if block.kind == "text" and block.task else text, found.labels)


def _compact(pieces: list[str]) -> str:
    return " ".join(" ".join(pieces).split())


def plain_text(markdown: str) -> str:
    """All text and code of a document, a space after each piece of it; markup and HTML are left out."""
    found = parse(markdown)
    return _compact([piece for block in found.blocks for piece in _texts(block, found)])


def _slug(title: str) -> str:
    return re.sub("[^a-z0-9]+", "-", "".join(c.lower() if c.isascii() else c for c in title)).strip("-") or "section"


def sections(markdown: str) -> list[dict]:
    """A document's sections in order; text before the first heading is one of level 0."""
    markdown = markdown.replace("\r\n", "\n")
    found = parse(markdown)
    heads = [b for b in found.blocks if b.kind == "heading"]
    ends = [*[b.start for b in heads[1:]], len(markdown)][: len(heads)]
    pieces = [(0, None, markdown[: heads[0].start if heads else len(markdown)].strip())]
    pieces = pieces if pieces[0][2] else []
    pieces += [(b.level, _compact(_texts(b, found)), markdown[b.start : end].strip()) for b, end in zip(heads, ends, strict=True)]
    out, path, owners, used = [], [], [], {}
    for index, (level, title, text) in enumerate(pieces):
        anchor, parent = None, None
        if title is not None:
            path = (path + [""] * level)[: level - 1] + [title]
            owners = (owners + [None] * level)[: level - 1]
            parent = next((o for o in reversed(owners) if o is not None), None)
            owners.append(index)
            base = _slug(title)
            used[base] = used.get(base, 0) + 1
            anchor = base if used[base] == 1 else f"{base}-{used[base]}"
        out.append(
            {
                "section_index": index,
                "heading_path": [p for p in path if p] if title is not None else [],
                "level": level,
                "parent": parent,
                "previous": index - 1 if index else None,
                "next": index + 1 if index + 1 < len(pieces) else None,
                "anchor": anchor,
                "markdown": text,
                "plain_text": plain_text(text),
                "content_hash": hashlib.sha256(text.encode()).hexdigest(),
            }
        )
    return out


def _sectioned(markdown: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The sections of NOTES documents at a time, whatever the size of the batches that come."""
    for batch in markdown:
        for at in range(0, len(batch), NOTES):
            yield batch.iloc[at : at + NOTES].map(lambda m: sections(m or ""))


def section_markdown(markdown: Column) -> Column:
    _sectioned.__annotations__ = {"markdown": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(_sectioned, f"array<{SECTION}>")(markdown)
