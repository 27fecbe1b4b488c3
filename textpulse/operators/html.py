"""Fields of HTML pages by walking their tags: elements by name, id, class, attribute or place
among their siblings, nested elements of one name included.

A page is read once, from left to right, with a stack of open elements, so time is linear in the
page however broken it is: an opening without an end swallows the rest of the page once. Pages
are walked in Arrow batches, one page at a time.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
_INSIDE = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
#: Elements without content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
_RAW_END = {name: re.compile(f"</{name}", re.IGNORECASE) for name in RAW}


@dataclass
class Element:
    """One element: ``first`` and ``last`` bound its pieces of text, ``end`` its descendants."""

    tag: str
    attributes: dict[str, str]
    parent: int
    first: int
    last: int = -1
    end: int = -1
    children: list[int] = field(default_factory=list)


class Page:
    """The elements of a page in document order, and its pieces of text (no comments, scripts, styles)."""

    def __init__(self, source: str, unescape: bool = True):
        self.unescape = entities.unescape if unescape else str
        self.elements = [Element("", {}, -1, 0)]
        self.pieces: list[str] = []
        stack, open_tags = [0], {}
        at, last_end = 0, source.rfind(">")
        while (found := _OPENING.search(source, at)) is not None:
            self._text(source, at, found.start())
            comment, other, slash, name = found.groups()
            if comment:
                end = source.find("-->", found.end())
                at = len(source) if end < 0 else end + 3
                continue
            if found.start() > last_end:  # no tag ends any more
                at = len(source)
                break
            inside = None if other else _INSIDE.match(source, found.end())
            at = inside.end() if inside else source.index(">", found.start()) + 1
            if other:
                continue
            name = name.lower()
            if slash:
                if open_tags.get(name):
                    while True:
                        closed = self.elements[stack.pop()]
                        closed.last, closed.end = len(self.pieces), len(self.elements)
                        open_tags[closed.tag] -= 1
                        if closed.tag == name:
                            break
                continue
            number = len(self.elements)
            attributes = {}
            for key, value in _ATTRIBUTE.findall(source, found.end(), at - 1):
                attributes.setdefault(key.lower(), entities.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
            element = Element(name, attributes, stack[-1], len(self.pieces))
            self.elements[stack[-1]].children.append(number)
            self.elements.append(element)
            if name in RAW:
                end = _RAW_END[name].search(source, at)
                close = -1 if end is None else source.find(">", end.end())
                at = len(source) if close < 0 else close + 1
            if name in VOID or name in RAW or source[at - 2 : at] == "/>":
                element.last, element.end = element.first, number + 1
            else:
                stack.append(number)
                open_tags[name] = open_tags.get(name, 0) + 1
        self._text(source, at, len(source))
        for number in stack:
            self.elements[number].last, self.elements[number].end = len(self.pieces), len(self.elements)

    def _text(self, source: str, start: int, end: int) -> None:
        if start < end:
            self.pieces.append(self.unescape(source[start:end]))

    def text(self, number: int = 0) -> str:
        element = self.elements[number]
        return "".join(self.pieces[element.first : element.last])

    def find(self, number: int, step: Step) -> list[int]:
        """The elements inside ``number`` that a step names, in document order."""
        element = self.elements[number]
        if step.child is not None:
            return element.children[step.child : step.child + 1]
        return [k for k in range(number + 1, element.end) if step.fits(self.elements[k])]

    def pick(self, path: Sequence[Step]) -> list[int]:
        """The elements at the end of a path: every step but the last goes on from its first find."""
        at = [0]
        for step in path:
            at = self.find(at[0], step) if at else []
        return at


@dataclass(frozen=True)
class Step:
    """Elements inside the current one: by ``tag``, ``id``, ``cls`` (one of its classes) and
    ``attributes``; or its ``child``-th child element."""

    tag: str | None = None
    id: str | None = None
    cls: str | None = None
    attributes: tuple[tuple[str, str], ...] = ()
    child: int | None = None

    def fits(self, element: Element) -> bool:
        have = element.attributes
        return (
            (self.tag is None or element.tag == self.tag)
            and (self.id is None or have.get("id") == self.id)
            and (self.cls is None or self.cls in have.get("class", "").split())
            and all(have.get(k) == v for k, v in self.attributes)
        )


@dataclass(frozen=True)
class PageField:
    """Text of the elements at the end of ``path``: of the first ones in ``places`` that is there
    (``places=(1, 0)``: the second, else the first), or of ``all``."""

    path: tuple[Step, ...]
    places: tuple[int, ...] = (0,)
    all: bool = False

    def value(self, page: Page) -> str | list[str]:
        found = page.pick(self.path)
        if self.all:
            return [page.text(k) for k in found]
        return next((page.text(found[p]) for p in self.places if p < len(found)), "")


def html_fields(html: Column, fields: Mapping[str, PageField], text: str | None = None, unescape: bool = True) -> Column:
    """A struct of the fields of a page: text, "" if not found; an array for ``all`` fields; under
    the name ``text`` the page's own text. A null page is an empty one. ``unescape``: character
    references in texts are resolved."""
    names = [*fields] + ([text] if text else [])
    kinds = ["array<string>" if f.all else "string" for f in fields.values()] + ["string"] * bool(text)

    @F.pandas_udf(", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
    def walk(sources: pd.Series) -> pd.DataFrame:
        rows = []
        for source in sources:
            page = Page(source or "", unescape)
            rows.append([f.value(page) for f in fields.values()] + ([page.text()] if text else []))
        return pd.DataFrame(rows, columns=names, dtype=object)

    return walk(html)


def with_html_fields(pages: DataFrame, fields: Mapping[str, PageField], html_col: str = "html", text: str | None = None, unescape: bool = True) -> DataFrame:
    """``pages`` with a column per field."""
    rows = pages.withColumn("_fields", html_fields(F.col(html_col), fields, text, unescape))
    return rows.withColumns({n: F.col(f"_fields.`{n}`") for n in [*fields, *([text] if text else [])]}).drop("_fields")
