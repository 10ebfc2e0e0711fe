"""Chapters out of HTML, free of Spark: a small tree from the standard parser, titles, tables of contents, headings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape, unescape
from html.entities import html5
from html.parser import HTMLParser

from inkwell.functions.strings import IMAGE_REFERENCE, OUTER_TAGS, PAGE_BREAK, WHOLE_BOOK_TITLE

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PAGE_BREAK, _OUTER, _IMAGE = re.compile(PAGE_BREAK), re.compile(OUTER_TAGS), re.compile(IMAGE_REFERENCE)
_REFERENCE, _TAG_OPEN = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"), re.compile("<")
MOST_TITLE = 100
#: White space that is trimmed: the separators U+001C to U+001F are none, though Python takes them so.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _decoded(text: str) -> str:
    """With its character references decoded; one that has no semicolon or no known name stays as it is."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[1][0] == "#" or f"{m[1]};" in html5 else m[0], text)


@dataclass
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    parts: list[Element | str] = field(default_factory=list)
    #: where the name of the start tag ends in the source
    name_end: int = 0

    def walk(self):
        """All elements below, in document order."""
        stack = [iter(self.parts)]
        while stack:
            for part in stack[-1]:
                if isinstance(part, Element):
                    yield part
                    stack.append(iter(part.parts))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        out: list[str] = []
        stack: list = [iter(self.parts)]
        while stack:
            for part in stack[-1]:
                if isinstance(part, Element):
                    stack.append(iter(part.parts))
                    break
                out.append(part)
            else:
                stack.pop()
        return _decoded("".join(out)).strip(WHITE)


class _Builder(HTMLParser):
    """Text comes as it is, its references undecoded: the parser does not tell those with a semicolon from those without, and
    takes all that follows a broken one as text."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=False)
        self.root = Element("")
        self.open = [self.root]
        self.lines = [0]
        for line in source.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(source)
        self.close()

    def reset(self):
        super().reset()
        self.interesting = _TAG_OPEN

    def clear_cdata_mode(self):
        super().clear_cdata_mode()
        self.interesting = _TAG_OPEN

    def handle_starttag(self, tag, attrs):
        row, column = self.getpos()
        made = Element(tag, {}, [], self.lines[row - 1] + column + 1 + len(tag))
        for name, value in attrs:
            made.attributes.setdefault(name, value or "")
        self.open[-1].parts.append(made)
        if tag not in _VOID:
            self.open.append(made)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def tree(html: str) -> Element:
    return _Builder(html).root


@dataclass
class Chapter:
    idx: int
    title: str
    anchor: str = ""
    html_content: str = ""


def _units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def title_of(html: str) -> str | None:
    """The first h1, else h2, else h3, else the first element marked as a title or chapter; under 100 UTF-16 units."""
    elements = list(tree(html).walk())
    wanted = [next((e for e in elements if e.tag == f"h{n}"), None) for n in (1, 2, 3)]
    marked = lambda e: "title" in e.attributes.get("class", "") or "chapter" in e.attributes.get("class", "") or e.attributes.get("id") == "chapter"
    wanted.append(next((e for e in elements if marked(e)), None))
    for e in wanted:
        if e is not None and (text := e.text()) and _units(text) < MOST_TITLE:
            return text
    return None


def _titled(elements: list[Element]) -> list[tuple[Element, str]]:
    pairs = [(e, e.text()) for e in elements]
    return [(e, text) for e, text in pairs if text and _units(text) <= MOST_TITLE]


def by_page_breaks(html: str) -> list[Chapter]:
    if not _PAGE_BREAK.search(html):
        return []
    chunks = [c for c in (x.strip(WHITE) for x in _PAGE_BREAK.split(html)) if c]
    return [Chapter(i, title_of(c) or f"第 {i + 1} 节", "", c) for i, c in enumerate(chunks)]


def by_contents(root: Element) -> list[Chapter]:
    """Links of the first table of contents: a nav of type toc, a nav of class toc, anything of id toc, a div of class toc."""
    elements = list(root.walk())
    tests = (
        lambda e: e.tag == "nav" and any(name.rpartition(":")[2] == "type" and value == "toc" for name, value in e.attributes.items()),
        lambda e: e.tag == "nav" and "toc" in e.attributes.get("class", ""),
        lambda e: e.attributes.get("id") == "toc",
        lambda e: e.tag == "div" and "toc" in e.attributes.get("class", ""),
    )
    found = next((e for test in tests for e in elements if test(e)), None)
    links = [e for e in found.walk() if e.tag == "a"] if found else []
    hrefs = [(unescape(e.attributes.get("href", "")), text) for e, text in _titled(links)]
    return [Chapter(i, text, "#" + href.partition("#")[2] if "#" in href else "") for i, (href, text) in enumerate(hrefs)]


def _headings(root: Element) -> list[tuple[Element, str]]:
    return _titled([e for e in root.walk() if e.tag in ("h1", "h2", "h3")])


def by_headings(root: Element) -> list[Chapter]:
    return [Chapter(i, text, f"#{e.attributes['id']}" if e.attributes.get("id") else f"#__ch{i}") for i, (e, text) in enumerate(_headings(root))]


def chapters(html: str, least_pages: int = 2) -> tuple[list[Chapter], str]:
    """The chapters and the strategy that gave them; page breaks give them if there are ``least_pages`` pages or more."""
    if not html.strip(WHITE):
        return [Chapter(0, WHOLE_BOOK_TITLE, "", html)], "blank"
    pages = by_page_breaks(html)
    if len(pages) >= least_pages:
        return pages, "pagebreak"
    root = tree(html)
    if found := by_contents(root):
        return found, "contents"
    if found := by_headings(root):
        return found, "headings"
    return [Chapter(0, WHOLE_BOOK_TITLE, "", _OUTER.sub("", html).strip(WHITE))], "whole"


def with_anchor_ids(html: str, found: list[Chapter]) -> str:
    """The html with an id on each heading that a made-up anchor names and that has none."""
    wanted = {c.anchor[1:] for c in found if c.anchor.startswith("#__ch")}
    if not wanted:
        return html
    out, at = [], 0
    for i, (e, _) in enumerate(_headings(tree(html))):
        if f"__ch{i}" in wanted and not e.attributes.get("id"):
            out += [html[at : e.name_end], f' id="{escape(f"__ch{i}")}"']
            at = e.name_end
    return "".join([*out, html[at:]])


def with_images(html: str, images: dict[int, tuple[str, str]]) -> str:
    """Image references by record number replaced by the image itself; unknown numbers stay as they are."""

    def shown(match: re.Match) -> str:
        number = int(match[1])
        if number not in images:
            return match[0]
        mime, data = images[number]
        return f"<img src='data:{mime};base64,{data}' style='max-width:100%;' />"

    return _IMAGE.sub(shown, html)
