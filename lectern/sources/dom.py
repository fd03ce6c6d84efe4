"""Pages of XHTML and HTML as trees: parsing, text fragments, rewriting.

Strict XML is tried first, after void tags are closed and the head is set
aside; anything it refuses goes to a lenient parser that builds the same kind
of tree.  Trees never leave a Python worker: a page is one string column.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import HEAD, VOID

# Elements without text of their own, elements that are part of their parent's text, void elements,
# and block elements before which an open paragraph ends.
IGNORED = {"title", "link", "style", "css", "img", "script", "metadata", "math"}
LEAVES = {"a", "b", "br", "hr", "span", "em", "strong", "label", "small"}
EMPTY = {"br", "hr", "img", "input", "col", "base", "meta", "area", "link", "wbr", "source", "track", "embed", "param"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
WHOLE, TEXT, TAIL = "WHOLE_DOM", "TEXT", "TAIL"
_HEAD, _VOID = re.compile(HEAD), re.compile(VOID)
XHTML = "http://www.w3.org/1999/xhtml"


def local(tag) -> str:
    """Tag name without its namespace."""
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


class _Lenient(HTMLParser):
    """Builds a tree from any markup: a block ends an open paragraph, stray end tags are dropped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("html")
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            self.root.attrib.update({k: v or "" for k, v in attrs if _NAME.match(k)})
            return
        if tag in BLOCKS:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == "p":
                    del self.stack[k:]
                    break
                if self.stack[k].tag in BLOCKS:
                    break
        node = ET.SubElement(self.stack[-1], tag, {k: v or "" for k, v in attrs if _NAME.match(k)})
        if tag not in EMPTY:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY and len(self.stack) > 1 and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data: str) -> None:
        node = self.stack[-1]
        data = _CONTROL.sub("", data)
        if len(node):
            node[-1].tail = (node[-1].tail or "") + data
        else:
            node.text = (node.text or "") + data


_NAME = re.compile(r"^[A-Za-z_][\w.\-]*$")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def parse(page: str) -> tuple[str, ET.Element, str | None]:
    """(head, root, namespace) of a page; comments are never text.

    Declarations of entities are refused by both parsers, so nothing outside
    the page is ever read.
    """
    head = _HEAD.match(page)[0]
    try:
        root = ET.fromstring(_VOID.sub(r"<\1\2 />", page[len(head) :]))
    except ET.ParseError:
        parser = _Lenient()
        parser.feed(page[len(head) :])
        parser.close()
        return head, parser.root, None
    space = root.tag[1:].partition("}")[0] if root.tag.startswith("{") else None
    if space:
        for node in root.iter():
            if isinstance(node.tag, str) and node.tag.startswith(f"{{{space}}}"):
                node.tag = node.tag[len(space) + 2 :]
    return head, root, space


def serialise(head: str, root: ET.Element, space: str | None) -> str:
    """The page as text, well formed, its namespace declared on the root."""
    if space:
        root.set("xmlns", space)
        for node in root.iter():
            if node.text is None and node.tag not in EMPTY:
                node.text = ""
    body = ET.tostring(root, encoding="unicode", short_empty_elements=True)
    if space:
        root.attrib.pop("xmlns", None)
    return head.rstrip() + "\n" + body.lstrip()


def inner_text(node: ET.Element) -> str:
    """Own text and that of all below, without the tail."""
    return "".join(node.itertext())


def fragments(node: ET.Element, parent: ET.Element | None = None) -> Iterator[tuple[ET.Element, str, ET.Element | None]]:
    """Text fragments in document order: whole nodes, texts and tails.

    A node whose children are all part of its text is one whole fragment, tail
    included; a tail is also a fragment of its own, so it is met twice.
    """
    if local(node.tag) in IGNORED:
        return
    if all(local(c.tag) in LEAVES for c in node):
        yield node, WHOLE, parent
    else:
        if filled(node.text):
            yield node, TEXT, parent
        for child in node:
            if local(child.tag) in LEAVES:
                yield child, WHOLE, node
            else:
                yield from fragments(child, node)
    if filled(node.tail):
        yield node, TAIL, parent


def filled(text: str | None) -> bool:
    return bool(text) and any(c not in " \n" for c in text)


def fragment_text(node: ET.Element, position: str) -> str:
    if position == TEXT:
        return node.text or ""
    if position == TAIL:
        return node.tail or ""
    return inner_text(node) + (node.tail or "")


def rewrite(page: str, texts: list) -> str:
    """The page with the k-th text added to the k-th fragment; null texts leave theirs as it is.

    A whole node gets a copy behind it that carries the text and takes over
    the tail; texts and tails are extended.  A text may be a list of pieces.
    """
    head, root, space = parse(page)
    found = list(fragments(root))
    for (node, position, parent), text in reversed(list(zip(found, texts))):
        if text is None:
            continue
        text = text if isinstance(text, str) else "".join(text)
        if position == WHOLE:
            if parent is None:
                continue
            copy = ET.Element(node.tag, {k: v for k, v in node.attrib.items() if k != "id"})
            copy.text, copy.tail, node.tail = text, node.tail, None
            parent.insert(list(parent).index(node) + 1, copy)
        elif position == TEXT:
            node.text = (node.text or "") + text
        else:
            node.tail = (node.tail or "") + text
    return serialise(head, root, space)


def with_anchors(page: str, anchors: dict[int, str]) -> str:
    """The page with a link behind each paragraph whose number, from 0 in document order, has one."""
    head, root, space = parse(page)
    parents = {child: node for node in root.iter() for child in node}
    for k, p in enumerate(list(root.iter("p"))):
        href = anchors.get(k)
        if href is not None and p in parents:
            link = ET.Element("a", {"href": href, "class": "nounder"})
            link.text, link.tail, p.tail = "#", p.tail, None
            parents[p].insert(list(parents[p]).index(p) + 1, link)
    return serialise(head, root, space)


def blank(page: str, title: str | None = None, inner: str = "") -> str:
    """The page with an emptied body, which gets a heading and ``inner``."""
    head, root, space = parse(page)
    body = next((n for n in root.iter() if local(n.tag) == "body"), None)
    if body is None:
        body = ET.SubElement(root, "body")
    tail = body.tail
    body.clear()
    body.tail = tail
    if title is not None:
        ET.SubElement(body, "h1").text = title
    if inner:
        for node in ET.fromstring(f"<x>{inner}</x>"):
            body.append(node)
    return serialise('<?xml version="1.0" encoding="utf-8"?>', root, space)


# Operators


def page_paragraphs(df: DataFrame, html: str = "html", index: str = "para_idx", out: str = "text") -> DataFrame:
    """One row for each ``p`` of a page, numbered in document order, with its text stripped; blank ones are left out.

    A null page has none.  Other columns are kept, ``index`` and ``out`` replaced.
    """
    rest = [c for c in df.columns if c not in (html, index, out)]

    @F.pandas_udf("array<struct<k:int, t:string>>")
    def texts(pages: pd.Series) -> pd.Series:
        def one(page):
            if page is None:
                return None
            return [{"k": k, "t": t} for k, p in enumerate(parse(page)[1].iter("p")) if (t := inner_text(p).strip())]

        return pd.Series([one(p) for p in pages])

    # marked so that a filter on its result can't make the parser run twice
    rows = df.select(*rest, F.explode(texts.asNondeterministic()(F.col(html))).alias("_p"))
    return rows.select(*rest, F.col("_p.k").alias(index), F.col("_p.t").alias(out))


def page_fragments(df: DataFrame, html: str = "html") -> DataFrame:
    """One row for each text fragment of a page: frag_idx, position, tag, text."""
    made = ["frag_idx", "position", "tag", "text"]
    rest = [c for c in df.columns if c not in (html, *made)]

    @F.pandas_udf("array<struct<frag_idx:int, position:string, tag:string, text:string>>")
    def walk(pages: pd.Series) -> pd.Series:
        def one(page):
            if page is None:
                return None
            return [{"frag_idx": k, "position": p, "tag": local(n.tag), "text": fragment_text(n, p)} for k, (n, p, _) in enumerate(fragments(parse(page)[1]))]

        return pd.Series([one(p) for p in pages])

    return df.select(*rest, F.explode(walk.asNondeterministic()(F.col(html))).alias("_f")).select(*rest, "_f.*")


def rewritten(html: Column | str, texts: Column | str) -> Column:
    """Pages with texts added to their fragments; a null page or list gives null or the page as it is."""

    @F.pandas_udf("string")
    def run(pages: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else rewrite(p, list(t)) if t is not None else p for p, t in zip(pages, lists)])

    return run.asNondeterministic()(html, texts)


def anchored(html: Column | str, anchors: Column | str) -> Column:
    """Pages with links behind their paragraphs, from an array of (para_idx, href)."""

    @F.pandas_udf("string")
    def run(pages: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else with_anchors(p, {a["para_idx"]: a["href"] for a in t} if t is not None else {}) for p, t in zip(pages, lists)])

    return run.asNondeterministic()(html, anchors)


def companion_pages(html: Column | str, title: Column | str, inner: Column | str) -> Column:
    """Companion pages on the pattern of their chapters: emptied, with a title and the notes' markup."""

    @F.pandas_udf("string")
    def run(pages: pd.Series, titles: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else blank(p, t, b or "") for p, t, b in zip(pages, titles, bodies)])

    return run.asNondeterministic()(html, title, inner)


def element(tag: str, text: str, **attributes: str) -> str:
    """One element as text, escaped."""
    given = "".join(f' {k.replace("_", "-")}="{escape(v)}"' for k, v in attributes.items())
    return f"<{tag}{given}>{escape(text, quote=False)}</{tag}>"
