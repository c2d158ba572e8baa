"""HTML as a tree, by the HTML standard's states: tags, character data, and the modes in which a tree is built.

Covered: where head and body begin, implied end tags, raw text and escapable raw text, tables with what is misplaced in
them moved before them, lists, headings, selects, stray end tags. Formatting elements are closed where their end tags
are and not opened anew: that changes no text and no link. Not covered: frames within frames, foreign elements' rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

#: Fixed values of the standard: kinds of elements.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("title textarea".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup listing main menu nav ol p plaintext pre search section summary ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
TABLE_CONTEXT = frozenset("table tbody tfoot thead tr".split())
SCOPE = frozenset("applet caption html marquee object table td template th".split())
SPECIAL = BLOCKS | HEADINGS | HEAD | TABLE_PARTS | SCOPE | VOID | frozenset("body button dd dt frameset head iframe li option select textarea".split()) - frozenset(["option"])
#: Elements nested deeper lie beside each other, as in browsers.
DEPTH = 512
_TOKEN = re.compile(r"<!--(?:-?>|(.*?)(?:--!?>|$))|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


@dataclass
class Node:
    """An element; a child is an element or a list of one text, which grows."""

    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | list[str]] = field(default_factory=list)
    parent: Node | None = None

    def elements(self) -> Iterator[Node]:
        """This element and all below it, in the order of the document."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self) -> list[str]:
        """The texts below, in order, each trimmed and none blank; what a template holds is not among them."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                out.append(node[0].strip())
            elif node.tag != "template" or node is self:
                stack += reversed(node.children)
        return [t for t in out if t]

    def within(self, tag: str) -> bool:
        node = self.parent
        while node is not None and node.tag != tag:
            node = node.parent
        return node is not None


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class _Builder:
    def __init__(self):
        self.html = Node("html")
        self.open, self.mode, self.head, self.body, self.frames, self.closed = [self.html], "before head", None, None, False, False

    # ---- placing ---------------------------------------------------------------------------------------------------

    def at(self) -> Node:
        return self.open[-1]

    def spot(self, foster: bool) -> tuple[Node, int]:
        """Where the next node goes: the end of the open element, or before the table for what a table cannot hold."""
        here = self.at()
        if foster and here.tag in TABLE_CONTEXT:
            for i in range(len(self.open) - 1, 0, -1):
                table = self.open[i]
                if table.tag == "table":
                    parent = table.parent or self.open[i - 1]
                    return parent, next(k for k, c in enumerate(parent.children) if c is table)
        return here, len(here.children)

    def insert(self, tag: str, attributes: dict[str, str] | None = None, foster: bool = False, push: bool = True) -> Node:
        parent, place = self.spot(foster)
        node = Node(tag, attributes or {}, [], parent)
        parent.children.insert(place, node)
        if push and tag not in VOID and (len(self.open) < DEPTH or tag in RAW or tag in ESCAPABLE):
            self.open.append(node)
        return node

    def write(self, text: str, foster: bool = False) -> None:
        parent, place = self.spot(foster)
        if place and isinstance(parent.children[place - 1], list):
            parent.children[place - 1][0] += text
        else:
            parent.children.insert(place, [text])

    def cut(self) -> None:
        """A comment ends a text node."""
        here = self.at()
        if self.mode not in ("before head", "in head", "after head") and not self.closed:
            here.children.append(Node("#comment", {}, [], here))

    # ---- the stack -------------------------------------------------------------------------------------------------

    def in_scope(self, tags: frozenset[str] | set[str], more: tuple[str, ...] = (), table: bool = False) -> bool:
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if node.tag in (("html", "table", "template") if table else SCOPE) or node.tag in more:
                return False
        return False

    def pop_to(self, tags: frozenset[str] | set[str]) -> None:
        while len(self.open) > 1 and self.open.pop().tag not in tags:
            pass

    def imply(self, but: str = "") -> None:
        while self.at().tag in IMPLIED and self.at().tag != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.in_scope({"p"}, ("button",)):
            self.pop_to({"p"})

    def clear_to(self, tags: set[str]) -> None:
        while self.at().tag not in tags and self.at().tag not in ("html", "template"):
            self.open.pop()

    def reset(self) -> None:
        """The mode that fits the open elements."""
        modes = {"tr": "in row", "tbody": "in table body", "thead": "in table body", "tfoot": "in table body", "caption": "in caption", "colgroup": "in column group", "table": "in table", "td": "in cell", "th": "in cell"}
        self.mode = next((modes[n.tag] for n in reversed(self.open) if n.tag in modes), "in body")

    # ---- modes -----------------------------------------------------------------------------------------------------

    def to_body(self) -> None:
        if self.body is None:
            del self.open[1:]
            self.body = self.insert("body")
        self.mode = "in body"

    def early(self, tag: str | None, attributes: dict[str, str], end: bool, blank: bool) -> bool:
        """The modes before a body; whether the token is done with."""
        if tag is None and blank:
            return True
        if self.mode == "before head":
            if not end and tag == "html":
                return True
            if not end and tag == "head":
                self.head, self.mode = self.insert("head", attributes), "in head"
                return True
            if end and tag not in ("head", "body", "html", "br"):
                return True
            self.head, self.mode = self.insert("head"), "in head"
        if self.mode == "in head":
            if end and tag == "template" and any(n.tag == "template" for n in self.open):
                self.pop_to({"template"})
                return True
            if self.at().tag == "template":
                return self.inside_template(tag, attributes, end)
            if not end and tag == "html" or not end and tag == "head":
                return True
            if not end and tag in HEAD:
                self.insert(tag, attributes)
                return True
            if end and tag == "head":
                self.open.pop()
                self.mode = "after head"
                return True
            if end and tag not in ("body", "html", "br"):
                return True
            self.open.pop()
            self.mode = "after head"
        if not end and tag == "body":
            self.to_body()
            self.body.attributes.update(attributes)
            return True
        if not end and tag == "frameset":
            self.frames = True
            return True
        if not end and tag in HEAD:
            self.open.append(self.head)
            self.insert(tag, attributes)
            self.open.remove(self.head)
            if self.at().tag == "template":
                self.mode = "in head"
                self.open.insert(1, self.head)
            return True
        if not end and tag in ("html", "head") or end and tag not in ("body", "html", "br"):
            return True
        self.to_body()
        return False

    def inside_template(self, tag: str | None, attributes: dict[str, str], end: bool) -> bool:
        """In a head's template nothing is seen; only its elements' nesting counts."""
        if tag is not None and not end:
            self.insert(tag, attributes)
        elif tag is not None and any(n.tag == tag for n in self.open[2:]) and tag != "template":
            self.pop_to({tag})
        return True

    def text(self, text: str) -> None:
        blank = not text.strip(" \t\n\f\r")
        if self.frames or (self.mode in ("before head", "in head", "after head") and self.early(None, {}, False, blank)):
            return
        if self.closed and not blank:
            self.closed = False
        if self.mode == "in column group" and not blank:
            self.open.pop()
            self.mode = "in table"
        self.write(text, foster=not blank and self.mode in ("in table", "in table body", "in row"))

    def start(self, tag: str, attributes: dict[str, str], bare: bool) -> None:
        """A start tag; bare: it ends with a slash."""
        if self.frames or (self.mode in ("before head", "in head", "after head") and self.early(tag, attributes, False, False)):
            return
        self.closed = False
        while not self.start_in_table(tag, attributes):
            pass
        if bare and self.at().tag == tag and any(self.at().within(x) or tag == x for x in ("svg", "math")):
            self.open.pop()

    def start_in_table(self, tag: str, attributes: dict[str, str]) -> bool:
        """A start tag in the mode that holds; false where the mode has changed and it comes again."""
        mode = self.mode
        if mode in ("in cell", "in caption"):
            if tag not in TABLE_PARTS:
                self.start_in_body(tag, attributes)
                return True
            if not self.in_scope({"td", "th"} if mode == "in cell" else {"caption"}, table=True):
                return True
            self.pop_to({"td", "th"} if mode == "in cell" else {"caption"})
            self.mode = "in row" if mode == "in cell" else "in table"
            return False
        if mode == "in column group":
            if tag == "col":
                self.insert(tag, attributes)
                return True
            self.open.pop()
            self.mode = "in table"
            return False
        if mode == "in row":
            if tag in ("td", "th"):
                self.clear_to({"tr"})
                self.insert(tag, attributes)
                self.mode = "in cell"
                return True
            if tag in TABLE_PARTS:
                self.clear_to({"tr"})
                self.open.pop()
                self.mode = "in table body"
                return False
        if mode == "in table body":
            if tag in ("tr", "td", "th"):
                self.clear_to({"tbody", "tfoot", "thead"})
                self.insert("tr", attributes if tag == "tr" else None)
                self.mode = "in row"
                return tag == "tr"
            if tag in TABLE_PARTS:
                self.clear_to({"tbody", "tfoot", "thead"})
                self.open.pop()
                self.mode = "in table"
                return False
        if mode == "in table" and tag in TABLE_PARTS:
            self.clear_to({"table"})
            if tag in ("caption", "colgroup", "tbody", "tfoot", "thead"):
                self.insert(tag, attributes)
                self.mode = {"caption": "in caption", "colgroup": "in column group"}.get(tag, "in table body")
                return True
            self.insert("colgroup" if tag == "col" else "tbody")
            self.mode = "in column group" if tag == "col" else "in table body"
            return False
        if mode in ("in table", "in table body", "in row"):
            if tag == "table":
                self.pop_to({"table"})
                self.reset()
                return False
            if tag in ("style", "script", "template"):
                self.insert(tag, attributes)
            elif tag == "input" and attributes.get("type", "").lower() == "hidden":
                self.insert(tag, attributes)
            elif tag != "form":
                self.start_in_body(tag, attributes, True)
            return True
        self.start_in_body(tag, attributes)
        return True

    def start_in_body(self, tag: str, attributes: dict[str, str], foster: bool = False) -> None:
        select = next((n for n in reversed(self.open) if n.tag == "select"), None)
        if tag in ("html", "body", "frameset", "head") or (tag in TABLE_PARTS and self.mode == "in body"):
            return
        if select is not None and tag not in ("option", "optgroup", "hr", "script", "template"):
            if tag not in ("select", "input", "keygen", "textarea"):
                return
            self.pop_to({"select"})
            if tag == "select":
                return
        if tag in HEAD and tag not in ("noscript", "noframes"):
            self.insert(tag, attributes, foster)
            return
        if tag in BLOCKS or tag in HEADINGS or tag in ("table", "hr"):
            self.close_p()
        if tag in HEADINGS and self.at().tag in HEADINGS:
            self.open.pop()
        if tag in ("li", "dd", "dt"):
            for node in reversed(self.open):
                if node.tag == tag or (tag != "li" and node.tag in ("dd", "dt")):
                    self.imply(node.tag)
                    self.pop_to({node.tag})
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p()
        if tag in ("a", "nobr") and any(n.tag == tag for n in self.open):
            self.end_formatting(tag)
        if tag == "button" and self.in_scope({"button"}):
            self.imply()
            self.pop_to({"button"})
        if tag in ("option", "optgroup") and self.at().tag == "option":
            self.open.pop()
        if tag == "optgroup" and self.at().tag == "optgroup":
            self.open.pop()
        self.insert("img" if tag == "image" else tag, attributes, foster)
        if tag == "table":
            self.mode = "in table"

    def end(self, tag: str) -> None:
        if self.frames or (self.mode in ("before head", "in head", "after head") and self.early(tag, {}, True, False)):
            return
        while not self.end_in_table(tag):
            pass

    def end_in_table(self, tag: str) -> bool:
        mode, cells = self.mode, {"td", "th"}
        if mode in ("in cell", "in caption"):
            own = cells if mode == "in cell" else {"caption"}
            if tag in own:
                if self.in_scope({tag}, table=True):
                    self.imply()
                    self.pop_to({tag})
                    self.mode = "in row" if mode == "in cell" else "in table"
            elif tag in TABLE_CONTEXT and (tag == "table" or mode == "in cell"):
                if self.in_scope({tag}, table=True) and self.in_scope(own, table=True):
                    self.pop_to(own)
                    self.mode = "in row" if mode == "in cell" else "in table"
                    return False
            elif tag not in TABLE_PARTS and tag not in ("body", "html"):
                self.end_in_body(tag)
            return True
        if mode == "in column group":
            if tag == "col":
                return True
            self.open.pop()
            self.mode = "in table"
            return tag == "colgroup"
        if mode == "in row" and tag in ("tr", "table", "tbody", "tfoot", "thead"):
            if tag not in ("tr", "table") and not self.in_scope({tag}, table=True):
                return True
            self.clear_to({"tr"})
            self.open.pop()
            self.mode = "in table body"
            return tag == "tr"
        if mode == "in table body" and tag in ("tbody", "tfoot", "thead", "table"):
            if tag != "table" and not self.in_scope({tag}, table=True):
                return True
            self.clear_to({"tbody", "tfoot", "thead"})
            self.open.pop()
            self.mode = "in table"
            return tag != "table"
        if mode in ("in table", "in table body", "in row"):
            if tag == "table":
                if self.in_scope({"table"}, table=True):
                    self.pop_to({"table"})
                    self.reset()
            elif tag not in TABLE_PARTS and tag not in ("body", "html"):
                self.end_in_body(tag, True)
            return True
        self.end_in_body(tag)
        return True

    def end_in_body(self, tag: str, foster: bool = False) -> None:
        if tag in ("body", "html"):
            self.closed = self.in_scope({"body"})
        elif tag == "p":
            if not self.in_scope({"p"}, ("button",)):
                self.insert("p", foster=foster)
            self.pop_to({"p"})
        elif tag == "br":
            self.insert("br", foster=foster)
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply()
                self.pop_to(HEADINGS)
        elif tag in FORMATTING:
            self.end_formatting(tag)
        elif tag in BLOCKS or tag in ("li", "dd", "dt", "button", "applet", "marquee", "object", "select", "template"):
            if self.in_scope({tag}, ("ol", "ul") if tag == "li" else ()) or (tag == "template" and any(n.tag == tag for n in self.open)):
                self.imply(tag)
                self.pop_to({tag})
                if tag in ("select", "template"):
                    self.reset()
        else:
            for node in reversed(self.open):
                if node.tag == tag:
                    self.imply(tag)
                    self.pop_to({tag})
                    return
                if node.tag in SPECIAL:
                    return

    def end_formatting(self, tag: str) -> None:
        """Closes a formatting element; blocks that were opened in it stay open."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                if any(n.tag in SPECIAL for n in self.open[i + 1 :]):
                    del self.open[i]
                    self.at().children.append(Node("#end", {}, [], self.at()))  # what follows is no longer in it
                else:
                    del self.open[i:]
                return
            if self.open[i].tag in SCOPE:
                return


def parse(source: str) -> Node:
    """The html element of a source, with a head and, but for frames, a body."""
    tree, at, size = _Builder(), 0, len(source)
    while at < size:
        here = tree.at().tag
        if here in RAW or here in ESCAPABLE or here == "plaintext":
            close = None if here == "plaintext" else re.compile(rf"</{here}(?=[\s/>])", re.I).search(source, at)
            raw = source[at : close.start() if close else size]
            raw = unescape(raw) if here in ESCAPABLE else raw
            if here == "textarea" and raw.startswith("\n"):
                raw = raw[1:]
            if raw:
                tree.write(raw)
            if close is None:
                break
            end = source.find(">", close.end())
            tree.open.pop()
            at = size if end < 0 else end + 1
            continue
        m = _TOKEN.search(source, at) if source.find(">", at) >= 0 or source.find("<!--", at) >= 0 else None
        text = source[at : m.start() if m else size]
        if m is None and re.search(r"<[/!?A-Za-z][^>]*$", text):  # a tag that never ends is dropped
            text = re.sub(r"<[/!?A-Za-z][^>]*$", "", text)
        if text:
            tree.text(unescape(text.replace("\0", "")))
        if m is None:
            break
        at = m.end()
        name = m[3]
        if not name:
            if not m[0].lower().startswith("<!doctype"):
                tree.cut()
        elif m[2]:
            tree.end(name.lower())
        else:
            tree.start(name.lower(), _attributes(m[4]), m[4].endswith("/"))
    if tree.body is None and not tree.frames:
        tree.text("x")
        tree.body.children.clear()
    return tree.html


def body_of(root: Node) -> Node | None:
    return next((c for c in root.children if isinstance(c, Node) and c.tag == "body"), None)
