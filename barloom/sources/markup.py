"""A small element tree of one landed page, for nodes whose extent depends on nesting."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html.parser import HTMLParser

# --- Fixed values: elements that never hold content.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


# --- Fixed values: the class names and addresses of the comment markup.
COMMENT_CLASSES = ["reply_item", "comment_item", "replyItem", "commentItem"]
COMMENT_LIST_CLASSES = ["reply-list", "comment-list"]
AUTHOR_CLASSES = ["author", "user", "name"]
AUTHOR_LINK = "i.eastmoney.com"
COMMENT_PART = re.compile("reply_item|comment_item")
CONTENT_PART = re.compile("content|text")

# --- Fixed values: start tags that end an open element of these names, up to the nearest open element of those.
IMPLIED_ENDS = {
    "li": (["li"], ["ul", "ol", "menu"]), "dt": (["dt", "dd"], ["dl"]), "dd": (["dt", "dd"], ["dl"]),
    "p": (["p"], ["body", "div", "li", "td", "th", "blockquote", "section", "article", "button"]),
    "option": (["option"], ["select"]), "tr": (["tr", "td", "th"], ["table"]), "td": (["td", "th"], ["table"]),
    "th": (["td", "th"], ["table"]),
}


@dataclass(slots=True)
class Element:
    tag: str
    attrs: dict[str, str]
    parent: Element | None = field(repr=False)
    chunk: int = 0
    chunk_end: int | None = None
    inside: range | None = None
    #: Whether it lies in an element of a comment-list class.
    listed: bool = False

    @property
    def classes(self) -> str:
        return self.attrs.get("class", "")

    def has_class(self, *names: str) -> bool:
        return not set(names).isdisjoint(self.classes.split())


class Page(HTMLParser):
    """Elements in document order, each with the run of text chunks and of elements it holds.

    An end tag closes the innermost open element of its name and all that are open within it; an
    end tag without a start is ignored, a list item, cell or paragraph ends where the next one begins, and what is
    never closed ends with the page.  Each open element knows its parent, so memory grows with the page alone.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.chunks: list[str] = []
        self.elements: list[Element] = []
        self._open: list[tuple[int, Element]] = []
        #: Places of open elements by name, innermost last.
        self._places: defaultdict[str, list[int]] = defaultdict(list)
        self.feed(html)
        self.close()
        while self._open:
            self._shut()

    def _innermost(self, names: list[str]) -> int:
        return max((self._places[n][-1] for n in names if self._places[n]), default=-1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in IMPLIED_ENDS:
            ended, bounds = IMPLIED_ENDS[tag]
            bound = self._innermost(bounds)
            while self._innermost(ended) > bound:
                self._shut_to(self._innermost(ended))
        parent = self._open[-1][1] if self._open else None
        listed = parent is not None and (parent.listed or parent.has_class(*COMMENT_LIST_CLASSES))
        element = Element(tag, {k: v or "" for k, v in reversed(attrs)}, parent, len(self.chunks), listed=listed)
        self._places[tag].append(len(self._open))
        self._open.append((len(self.elements), element))
        self.elements.append(element)
        if tag in VOID_TAGS:
            self._shut()

    def handle_endtag(self, tag: str) -> None:
        if self._places[tag]:
            self._shut_to(self._places[tag][-1])

    def _shut_to(self, place: int) -> None:
        while len(self._open) > place:
            self._shut()

    def handle_data(self, data: str) -> None:
        self.chunks.append(data)

    def _shut(self) -> Element:
        index, element = self._open.pop()
        self._places[element.tag].pop()
        element.chunk_end = len(self.chunks)
        element.inside = range(index + 1, len(self.elements))
        return element

    def text(self, element: Element) -> str:
        """Visible text of an element, blanks collapsed."""
        return " ".join(" ".join(self.chunks[element.chunk:element.chunk_end]).split())

    def first(self, element: Element, wanted) -> Element | None:
        return next((e for k in element.inside if wanted(e := self.elements[k])), None)


def comment_nodes(html: str | None) -> list[dict]:
    """Comment elements of a page in document order: index, whole text, content and author.

    A comment is an element of a comment class or an item of any comment list, nested ones included.
    """
    page = Page(html or "")

    def is_comment(e: Element) -> bool:
        return (e.has_class(*COMMENT_CLASSES) or bool(COMMENT_PART.search(e.classes))
                or (e.tag == "li" and e.listed))

    def is_author(e: Element) -> bool:
        return e.has_class(*AUTHOR_CLASSES) or (e.tag == "a" and AUTHOR_LINK in e.attrs.get("href", ""))

    out = []
    for index, node in enumerate(filter(is_comment, page.elements)):
        text = page.text(node)
        content = page.first(node, lambda e: CONTENT_PART.search(e.classes))
        author = page.first(node, is_author)
        out.append({"index": index, "text": text, "content": page.text(content) if content else text,
                    "author": page.text(author) if author else None})
    return out
