"""HTML article bodies to labelled text blocks: a small per-document helper and its Arrow UDF."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from quillspark import fixed_values as fixed, schema

# Element classes.
VOID = set("area base basefont bgsound br col command embed frame hr image img input isindex keygen "
           "link menuitem meta nextid param source spacer track wbr".split())
HIDDEN_TEXT = {"rp", "rt", "script", "style", "template"}
DROPPED = {"script", "style", "nav"}
HEADINGS = {f"h{n}" for n in range(1, 7)}
PARAGRAPHS = {"p", "li", "figcaption", "pre", "blockquote"}
EQUATIONS = {"ltx_equation", "ltx_equationgroup"}


class Element:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))


class Aside(str):
    """Text that a container shows but that is not part of an element's own text (comments)."""


class TreeReader(HTMLParser):
    """Builds the element tree without inventing missing end tags.

    An end tag closes everything up to the nearest open element of that name, and is ignored when
    there is none. Unclosed elements therefore nest.
    """

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=False)
        self.root = Element("", {})
        self.open, self.pieces, self.closed_voids = [self.root], [], []
        self.feed(markup)
        self.close()
        self._end_text()

    def _end_text(self, kind: type = str):
        if self.pieces:
            hidden = any(e.name in HIDDEN_TEXT for e in self.open)
            self.open[-1].children.append((Aside if hidden else kind)("".join(self.pieces)))
            self.pieces = []

    def _aside(self, text: str):
        self._end_text()
        self.pieces = [text]
        self._end_text(Aside)

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs)
        if tag in VOID:
            self._end(tag)
            self.closed_voids.append(tag)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs)
        self._end(tag)

    def handle_endtag(self, tag):
        if tag in self.closed_voids:
            self.closed_voids.remove(tag)
        else:
            self._end(tag)

    def _start(self, tag, attrs):
        self._end_text()
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(element)
        self.open.append(element)

    def _end(self, tag):
        self._end_text()
        depth = len(self.open) - 1
        while depth and self.open[depth].name != tag:
            depth -= 1
        if depth:
            del self.open[depth:]

    def handle_data(self, data):
        self.pieces.append(data)

    def handle_entityref(self, name):
        self.pieces.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        self.pieces.append(unescape(f"&#{name};"))

    def handle_comment(self, data):
        self._aside(data)

    def handle_decl(self, decl):
        self._aside(decl)

    def handle_pi(self, data):
        self._aside(data)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._end_text()
            self.pieces = [data[len("CDATA["):]]
            self._end_text()
        else:
            self._aside(data)


def own_text(element: Element) -> str:
    """All text below an element: stripped pieces joined by single spaces."""
    pieces, stack = [], [element]
    while stack:
        node = stack.pop()
        if isinstance(node, Element):
            stack.extend(reversed(node.children))
        elif not isinstance(node, Aside) and node.strip():
            pieces.append(node.strip())
    return " ".join(pieces)


def _find_article(root: Element) -> Element | None:
    articles = [e for e in root.walk() if e.name == "article"]
    marked = [e for e in articles if "ltx_document" in e.classes()]
    return next(iter(marked or articles), None)


def _simplify(article: Element):
    """Drop navigation and scripts; turn formulas and images into text."""
    for node in article.walk():
        node.children = [c for c in node.children if not (
            isinstance(c, Element) and (c.name in DROPPED or "ltx_page_navbar" in c.classes()))]
    for node in list(article.walk()):
        node.children = [
            f" ${c.attrs.get('alttext') or own_text(c)}$ "
            if isinstance(c, Element) and c.name == "math" else c for c in node.children]
    for node in article.walk():
        node.children = [
            f" [Figure image: {c.attrs.get('alt', 'see original')}] "
            if isinstance(c, Element) and c.name == "img" else c for c in node.children]


def _table_text(table: Element) -> str:
    rows = (e for e in table.walk() if e.name == "tr")
    return "\n".join(
        " | ".join(own_text(c) for c in row.children
                   if isinstance(c, Element) and c.name in ("td", "th"))
        for row in rows).strip()


def article_blocks(markup: str) -> list[tuple[str, str]]:
    """(label, text) blocks in document order; raises ValueError when there is no usable article."""
    article = _find_article(TreeReader(markup).root)
    if article is None:
        raise ValueError("Response has no article body (may be an error page)")
    _simplify(article)
    label, blocks, stack = fixed.HTML_START_LABEL, [], [article]
    while stack:
        node = stack.pop()
        if not isinstance(node, Element):
            if node.strip():
                blocks.append((label, node.strip()))
        elif node.name in HEADINGS:
            label = own_text(node)
            blocks.append((label, "#" * int(node.name[1]) + " " + label))
        elif node.name == "table":
            text = _table_text(node)
            if text:
                blocks.append((label, text))
        elif node.name in PARAGRAPHS:
            text = own_text(node)
            if text:
                blocks.append((label, text))
        elif node.classes() & EQUATIONS:
            blocks.append((label, own_text(node)))
        else:
            stack.extend(reversed(node.children))
    if sum(len(text) for _, text in blocks) < fixed.MIN_HTML_TEXT_CHARS:
        raise ValueError("HTML text is implausibly short for a full text")
    return blocks


def blocks_or_error(markup: str | bytes) -> tuple[list[tuple[str, str]] | None, str | None]:
    if isinstance(markup, bytes):
        markup = markup.decode("utf-8", errors="replace")
    try:
        return article_blocks(markup), None
    except ValueError as problem:
        return None, str(problem)


@F.pandas_udf(schema.EXTRACTED_BLOCKS)
def html_blocks(markup: pd.Series) -> pd.DataFrame:
    """Blocks of each HTML document, or the reason why there are none."""
    found = [blocks_or_error(m) for m in markup]
    return pd.DataFrame({
        "blocks": [b and [{"label": k, "text": t} for k, t in b] for b, _ in found],
        "error": [e for _, e in found]})
