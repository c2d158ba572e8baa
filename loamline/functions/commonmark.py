"""Blocks and inline text of CommonMark, with tables, strikethrough and task lists.

Blocks: one pass over the lines with a stack of open containers. Each line first finds the containers it continues, by
quote marks and by the content offsets of list items; what it then begins closes the others, unless it goes on with a
paragraph lazily. Inline: one pass with a stack of brackets and a stack of delimiter runs. Link definitions are collected
by the first pass, so that the second knows them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field
from html.entities import html5

#: Names of tags that begin an HTML block, which ends at a blank line.
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
#: Parentheses that may be open at once in the target of a link.
NESTED = 5
_ATTRIBUTE = r"""\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
_TAG = rf"<(?:[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*)>"
_MARKUP = re.compile(rf"{_TAG}|<!--(?:>|->|.*?-->)|<\?.*?\?>|<![A-Za-z].*?>|<!\[CDATA\[.*?\]\]>", re.S)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
#: How an HTML block begins, and what its last line holds; None: it ends at a blank line.
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[ \t>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"</?(?:" + "|".join(BLOCK_TAGS) + r")(?:[ \t]|/?>|$)", re.I), None),
]
_LONE_TAG = re.compile(rf"{_TAG}[ \t]*$")
_ATX = re.compile(r"(#{1,6})(?=[ \t]|$)(.*)$", re.S)
_FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
_UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
_RULE = re.compile(r"([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"(?:[-*+]|(\d{1,9})[.)])(?=[ \t]|$)")
_DASHES = re.compile(r":?-+:?")
_LABEL = r"\[((?:[^\[\]\\]|\\.){1,999})\]"
_TARGET = r"<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*"
_TITLE = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)"""
_DEFINITION = re.compile(rf"{_LABEL}:[ \t]*\n?[ \t]*(?:{_TARGET})(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:{_TITLE}))?[ \t]*(?:\n|$)", re.S)
_BARE_DEFINITION = re.compile(rf"{_LABEL}:[ \t]*\n?[ \t]*(?:{_TARGET})[ \t]*(?:\n|$)", re.S)
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{0,31});")
_ASCII_MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass
class Block:
    """kind: heading, text, code, row or rule. start: where it begins in the source. texts: lines, or the cells of a row."""

    kind: str
    start: int
    texts: list[str]
    level: int = 0
    task: bool = False  # whether it begins a list item


@dataclass
class Document:
    blocks: list[Block] = field(default_factory=list)
    labels: set[str] = field(default_factory=set)


class _Line:
    """A line and how far it is read: in characters, and in columns, of which a tab may have some left."""

    def __init__(self, text: str, start: int):
        self.text, self.start, self.at, self.column, self.spare = text, start, 0, 0, 0

    def indent(self) -> int:
        """The columns of white space ahead."""
        n, column, at = self.spare, self.column + self.spare, self.at
        while at < len(self.text) and self.text[at] in " \t":
            wide = 1 if self.text[at] == " " else 4 - column % 4
            n, column, at = n + wide, column + wide, at + 1
        return n

    def skip(self, columns: int) -> None:
        """Reads columns of white space, or as many as there are."""
        taken = min(columns, self.spare)
        self.spare, self.column, columns = self.spare - taken, self.column + taken, columns - taken
        while columns and self.at < len(self.text) and self.text[self.at] in " \t":
            wide = 1 if self.text[self.at] == " " else 4 - self.column % 4
            taken = min(wide, columns)
            self.at, self.column, self.spare, columns = self.at + 1, self.column + taken, wide - taken, columns - taken

    def take(self, chars: int) -> None:
        self.at, self.column = self.at + chars, self.column + chars

    def rest(self) -> str:
        return " " * self.spare + self.text[self.at :]

    def blank(self) -> bool:
        return not self.text[self.at :].strip(" \t")

    def place(self) -> int:
        return self.start + self.at


def normal_label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _cells(row: str) -> list[str]:
    """The cells of a table's row; an escaped bar belongs to its cell."""
    parts = re.split(r"(?<!\\)\|", row.strip())
    parts = parts[1:] if not parts[0].strip() and len(parts) > 1 else parts
    parts = parts[:-1] if len(parts) > 1 and not parts[-1].strip() else parts
    return [p.strip().replace("\\|", "|") for p in parts]


class _Blocks:
    """The open containers and the open leaf while lines go by. A container is the width of a list item, or None for a quote."""

    def __init__(self):
        self.found, self.containers, self.empty_item, self.new_item = Document(), [], False, False
        self.leaf, self.open, self.fence, self.ending, self.columns = None, None, ("", 0, 0), None, 0

    def close(self) -> None:
        block, self.leaf, self.open = self.open, None, None
        if block is None or block.kind != "text":
            return
        text = "\n".join(block.texts)
        while text.startswith("[") and (m := _DEFINITION.match(text) or _BARE_DEFINITION.match(text)) and m[1].strip():
            self.found.labels.add(normal_label(m[1]))
            text = text[m.end() :]
        block.texts = text.split("\n") if text.strip() else []
        if not block.texts:
            self.found.blocks.remove(block)

    def begin(self, kind: str, block: Block | None) -> None:
        self.close()
        if block is not None:
            block.task = self.new_item
        self.empty_item = self.new_item = False
        self.leaf, self.open = kind, block
        if block is not None:
            self.found.blocks.append(block)

    def continued(self, line: _Line) -> int:
        """How many of the open containers the line goes on with; what marks them is read."""
        for n, width in enumerate(self.containers):
            last = n == len(self.containers) - 1
            if width is None:
                if line.indent() > 3 or not line.text[line.at :].lstrip(" \t").startswith(">"):
                    return n
                self.quote(line)
            elif line.blank():
                if last and self.empty_item:
                    return n
            elif line.indent() >= width:
                line.skip(width)
            else:
                return n
        return len(self.containers)

    @staticmethod
    def quote(line: _Line) -> None:
        line.skip(3)
        line.take(1)
        line.skip(1)

    def item(self, line: _Line, indent: int, marker: str) -> None:
        """Opens a list item; its content begins after the marker and one to four columns."""
        line.skip(indent)
        line.take(len(marker))
        gap = line.indent()
        if line.blank():
            width, self.empty_item = indent + len(marker) + 1, True
        else:
            gap, self.empty_item = gap if gap <= 4 else 1, False
            line.skip(gap)
            width = indent + len(marker) + gap
        self.containers.append(width)
        self.new_item = True

    def add(self, text: str, start: int) -> None:
        line = _Line(text, start)
        matched = self.continued(line)
        whole, fresh = matched == len(self.containers), False
        if whole and self.leaf == "fence":
            mark, size, indent = self.fence
            m = re.fullmatch(rf"({re.escape(mark)}{{{size},}})[ \t]*", line.rest().strip(" ")) if line.indent() < 4 else None
            if m:
                self.close()
            else:
                line.skip(indent)
                self.open.texts.append(line.rest())
            return
        if whole and self.leaf == "html":
            if (line.blank() and self.ending is None) or (self.ending is not None and self.ending.search(line.rest())):
                self.close()
            return
        while True:
            paragraph = self.leaf == "text" and whole and not fresh
            indent = line.indent()
            if line.blank() or indent > 3:
                break
            rest = line.text[line.at :].lstrip(" \t")
            if rest[0] == ">":
                self.reach(matched)
                self.quote(line)
                self.containers.append(None)
            elif paragraph and _UNDERLINE.match(rest) and self.underlined(rest):
                return
            elif m := _ATX.match(rest):
                self.reach(matched)
                line.skip(indent)
                title = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", m[2])
                self.begin("heading", Block("heading", line.place(), [title.strip(" \t")], len(m[1])))
                self.close()
                return
            elif m := _FENCE.match(rest):
                self.reach(matched)
                line.skip(indent)
                mark = m[1] or m[2]
                self.fence = (mark[0], len(mark), indent)
                self.begin("fence", Block("code", line.place(), []))
                return
            elif found := next(((b, e) for b, e in _HTML if b.match(rest)), None) or (None if self.leaf == "text" else _LONE_TAG.match(rest) and (None, None)):
                self.reach(matched)
                self.begin("html", None)
                self.ending = found[1]
                if self.ending is not None and self.ending.search(rest[found[0].match(rest).end() :]):
                    self.close()
                return
            elif _RULE.match(rest):
                self.reach(matched)
                self.begin("rule", Block("rule", line.place(), []))
                self.close()
                return
            elif (m := _ITEM.match(rest)) and not (paragraph and (m[1] not in (None, "1") or not rest[m.end() :].strip())):
                self.reach(matched)
                self.close()
                self.item(line, indent, m[0])
            else:
                break
            matched, whole, fresh = len(self.containers), True, True
        self.text(line, matched, whole, fresh)

    def reach(self, matched: int) -> None:
        """Closes the leaf and the containers beyond those that the line goes on with."""
        self.close()
        del self.containers[matched:]

    def underlined(self, rest: str) -> bool:
        """Makes the open paragraph a heading, if more than definitions is in it."""
        block = self.open
        self.close()
        if not block.texts:
            return False
        block.kind, block.level = "heading", 1 if rest[0] == "=" else 2
        return True

    def text(self, line: _Line, matched: int, whole: bool, fresh: bool) -> None:
        """The rest of a line that begins no block."""
        if line.blank():
            if not whole:
                self.reach(matched)
            if self.leaf in ("text", "table"):
                self.close()
            if self.containers and self.containers[-1] is not None and not fresh and self.empty_item:
                self.containers.pop()
            return
        if self.leaf == "text" and not fresh and (whole or matched < len(self.containers)):
            if whole and len(self.open.texts) == 1 and self.table(line.rest()):
                return
            self.open.texts.append(line.rest().lstrip(" \t"))  # lazily, where not whole
            return
        if not whole:
            self.reach(matched)
        if line.indent() > 3:
            if self.leaf != "code":
                self.begin("code", Block("code", line.place(), []))
            line.skip(4)
            self.open.texts.append(line.rest())
        elif self.leaf == "table" and not fresh:
            self.begin("table", Block("row", line.place(), (_cells(line.rest()) + [""] * self.columns)[: self.columns]))
        else:
            line.skip(3)
            self.begin("text", Block("text", line.place(), [line.rest()]))

    def table(self, rest: str) -> bool:
        """Begins a table, if the line is a row of dashes for the one line of the open paragraph."""
        block = self.open
        head, dashes = _cells(block.texts[0]), _cells(rest)
        if "|" not in block.texts[0] + rest or len(head) != len(dashes) or not all(_DASHES.fullmatch(d) for d in dashes):
            return False
        block.kind, block.texts, self.columns = "row", head, len(head)
        self.leaf, self.open = "table", block
        return True


def parse(source: str) -> Document:
    """The blocks of a source whose lines end with line feeds."""
    state, start = _Blocks(), 0
    for text in source.split("\n"):
        state.add(text, start)
        start += len(text) + 1
    state.close()
    return state.found


@dataclass
class _Run:
    """A run of delimiters: its character, its nodes that are left, and whether it can open and close."""

    char: str
    nodes: list[int]
    size: int
    opens: bool
    closes: bool


@dataclass
class _Bracket:
    node: int
    image: bool
    begin: int
    runs: int
    active: bool = True


def _is_mark(c: str) -> bool:
    return c in _ASCII_MARKS or unicodedata.category(c)[0] in "PS"


def _flanks(before: str, char: str, after: str) -> tuple[bool, bool]:
    """Whether a run between two characters (empty at an end) can open, and close."""
    space = lambda c: not c or c.isspace()
    left = not space(after) and (not _is_mark(after) or space(before) or _is_mark(before))
    right = not space(before) and (not _is_mark(before) or space(after) or _is_mark(after))
    if char != "_":
        return left, right
    return left and (not right or _is_mark(before)), right and (not left or _is_mark(after))


def _balance(runs: list[_Run], nodes: list) -> None:
    """Pairs the delimiters of runs; those that pair vanish from nodes."""
    lowest: dict[tuple, int] = {}
    i = 0
    while i < len(runs):
        closer = runs[i]
        if not closer.closes or not closer.nodes:
            i += 1
            continue
        kind, j = (closer.char, closer.opens, closer.size % 3), i - 1
        least = lowest.get(kind, -1)
        while j > least:
            opener = runs[j]
            odd = (opener.closes or closer.opens) and (opener.size + closer.size) % 3 == 0 and (opener.size % 3 or closer.size % 3)
            fits = len(opener.nodes) == len(closer.nodes) if closer.char == "~" else not odd
            if opener.char == closer.char and opener.opens and opener.nodes and fits:
                break
            j -= 1
        if j <= least:
            lowest[kind] = i - 1
            i += 1
            continue
        opener = runs[j]
        n = len(closer.nodes) if closer.char == "~" else 2 if len(opener.nodes) > 1 and len(closer.nodes) > 1 else 1
        for k in opener.nodes[-n:] + closer.nodes[:n]:
            nodes[k] = None
        opener.nodes, closer.nodes = opener.nodes[:-n], closer.nodes[n:]
        for between in runs[j + 1 : i]:
            between.opens = between.closes = False


def _after_link(text: str, at: int) -> int | None:
    """Where an inline link's (target "title") ends, if there is one at at."""
    m = re.compile(r"\([ \t\n]*").match(text, at)
    if not m:
        return None
    at = m.end()
    if text[at : at + 1] == "<":
        m = re.compile(r"<(?:[^<>\n\\]|\\.)*>").match(text, at)
        if not m:
            return None
        at = m.end()
    else:
        depth = 0
        while at < len(text) and not text[at].isspace() and text[at] >= " ":
            if text[at] == "\\" and text[at + 1 : at + 2] in _ASCII_MARKS:
                at += 1
            elif text[at] == "(":
                depth += 1
                if depth > NESTED:
                    return None
            elif text[at] == ")":
                if not depth:
                    break
                depth -= 1
            at += 1
        if depth:
            return None
    m = re.compile(rf"(?:[ \t\n]+(?:{_TITLE}))?[ \t\n]*\)", re.S).match(text, at)
    return m.end() if m else None


def inline(text: str, labels: set[str]) -> list[str]:
    """The pieces of text that a paragraph, heading or cell shows, in order; a line break is a piece of one space.

    A piece ends where markup, an entity or an escape begins, as in a stream of parser events.
    """
    nodes: list[str | None] = []
    runs: list[_Run] = []
    brackets: list[_Bracket] = []
    text = text.strip(" \t\n")
    begin = at = 0
    special = re.compile(r"[\\`&<*_~!\[\]\n]")

    def flush(to: int) -> None:
        if to > begin:
            nodes.append(text[begin:to])

    while at < len(text):
        found = special.search(text, at)
        if not found:
            break
        at, c = found.start(), found[0]
        after = at + 1
        if c == "\\":
            if text[after : after + 1] == "\n":
                flush(at)
                nodes.append(" ")
                begin = at = re.compile(r"[ \t]*").match(text, after + 1).end()
            elif text[after : after + 1] in _ASCII_MARKS and after < len(text):
                flush(at)
                begin, at = after, after + 1
            else:
                at = after
            continue
        if c == "\n":
            flush(at - len(text[begin:at]) + len(text[begin:at].rstrip(" ")))
            nodes.append(" ")
            begin = at = re.compile(r"[ \t]*").match(text, after).end()
            continue
        if c == "`":
            run = re.compile("`+").match(text, at)[0]
            close = re.compile(rf"(?<!`){run}(?!`)").search(text, at + len(run))
            flush(at)
            if close:
                code = text[at + len(run) : close.start()].replace("\n", " ")
                nodes.append(code[1:-1] if code[:1] == code[-1:] == " " and code.strip(" ") else code)
                at = close.end()
            else:
                nodes.append(run)
                at += len(run)
            begin = at
            continue
        if c == "&":
            m = _ENTITY.match(text, at)
            if m and (m[0][1] == "#" or m[0][1:] in html5):
                flush(at)
                nodes.append(html.unescape(m[0]))
                begin = at = m.end()
            else:
                at = after
            continue
        if c == "<":
            link, m = _AUTOLINK.match(text, at), _MARKUP.match(text, at)
            flush(at)
            nodes += [link[1]] if link else [] if m else ["<"]
            begin = at = (link or m).end() if link or m else after
            continue
        if c in "*_~":
            run = re.compile(re.escape(c) + "+").match(text, at)[0]
            end = at + len(run)
            opens, closes = _flanks(text[at - 1 : at], c, text[end : end + 1])
            if (opens or closes) and (c != "~" or len(run) < 3):
                flush(at)
                runs.append(_Run(c, list(range(len(nodes), len(nodes) + len(run))), len(run), opens, closes))
                nodes += run
                begin = end
            at = end
            continue
        if c == "[" or (c == "!" and text[after : after + 1] == "["):
            flush(at)
            begin = at = after + (c == "!")
            brackets.append(_Bracket(len(nodes), c == "!", at, len(runs)))
            nodes.append(text[at - 1 - (c == "!") : at])
            continue
        if c == "]":
            flush(at)
            begin = at = after
            bracket = brackets.pop() if brackets else None
            end = None
            if bracket and bracket.active:
                end = _after_link(text, after)
                if end is None and (m := re.compile(_LABEL).match(text, after)):
                    end = m.end() if normal_label(m[1]) in labels else None
                elif end is None and normal_label(text[bracket.begin : after - 1]) in labels:
                    end = after + 2 if text[after : after + 2] == "[]" else after
            if end is None:
                nodes.append("]")
                continue
            nodes[bracket.node] = None
            _balance(runs[bracket.runs :], nodes)
            del runs[bracket.runs :]
            if not bracket.image:
                for b in brackets:
                    b.active = b.active and b.image
            begin = at = end
            continue
        at = after
    flush(len(text))
    _balance(runs, nodes)
    return [n for n in nodes if n]
