"""Values out of stored web pages. Every result row keeps its page's key; a page without a match
keeps its row, with a status instead of a stand-in text.

Pages are scanned by the standard library's tokenizer inside Arrow batches, with a stack of open elements: nested elements of
one name, entities, comments, void and unclosed elements come out as a browser would read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: elements that have no content and no closing tag
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: elements whose text isn't shown
HIDDEN = {"script", "style", "template"}


def _has_class(value: str | None, wanted: str | None) -> bool:
    """A single class is any of the element's classes, several are the exact text."""
    if wanted is None:
        return True
    if value is None:
        return False
    return value == wanted if wanted.split() != [wanted] else wanted in value.split()


class _Scanner(HTMLParser):
    """Attributes and text of every element of a name and class, in the order of their opening tags.

    A closing tag closes all elements opened since its own; one without an open element is passed over. An element that is
    never closed reaches to its parent's end.
    """

    def __init__(self, tag: str, css_class: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.css_class = tag.lower(), css_class
        self.found: list[tuple[dict, list[str]]] = []
        self.open: list[tuple[str, int]] = []  # name, and number of the element if it is wanted
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, tag in VOID)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, True)

    def _start(self, tag: str, attrs: list[tuple[str, str | None]], empty: bool) -> None:
        number = -1
        if tag == self.tag:
            own: dict[str, str | None] = {}
            for name, value in attrs:  # of equal names the first counts
                own.setdefault(name, value)
            if _has_class(own.get("class"), self.css_class):
                number = len(self.found)
                self.found.append((own, []))
        if not empty:
            self.open.append((tag, number))
            self.hidden += tag in HIDDEN

    def handle_endtag(self, tag: str) -> None:
        if any(name == tag for name, _ in self.open):
            while True:
                name, _ = self.open.pop()
                self.hidden -= name in HIDDEN
                if name == tag:
                    return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            for _, number in self.open:
                if number >= 0:
                    self.found[number][1].append(data)


def _scan(page: str | None, tag: str, css_class: str | None) -> list[tuple[dict, str]]:
    scanner = _Scanner(tag, css_class)
    if page:
        scanner.feed(page)
        scanner.close()
    return [(attrs, "".join(parts).strip()) for attrs, parts in scanner.found]


def _status(text: str | None) -> str:
    return "missing" if text is None else "ok" if text else "empty"


def _scanned(df: DataFrame, html: str, key: str, fields: str, rows) -> DataFrame:
    """A row for each result of ``rows(page)``, with the page's key in front."""
    kind = df.select(key).schema[key].dataType.simpleString()
    names = [key, *[f.split()[0] for f in fields.split(", ")]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *row) for i, page in enumerate(batch.column(1).to_pylist()) for row in rows(page)]
            at, *values = zip(*found) if found else ([],) * len(names)
            types = [{"int": pa.int32(), "string": pa.string()}[f.split()[1]] for f in fields.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *map(pa.array, values, types)], names)

    return df.select(F.col(key), F.col(html).cast("string")).mapInArrow(work, f"`{key}` {kind}, {fields}")


def extract_tag_text(df: DataFrame, html: str, tag: str, css_class: str | None = None, key: str = "page_id") -> DataFrame:
    """``(key, position, text, status)``: stripped text of every matching element, with that of the elements inside it.

    Entities are decoded. Status: ok, empty (element without text) or missing (no such element, or no page).
    """

    def rows(page: str | None) -> list[tuple]:
        found = [(i, text or None, _status(text)) for i, (_, text) in enumerate(_scan(page, tag, css_class))]
        return found or [(None, None, _status(None))]

    return _scanned(df, html, key, "position int, text string, status string", rows)


def first_link(df: DataFrame, html: str, css_class: str | None = None, key: str = "page_id") -> DataFrame:
    """``(key, href, status)``: target of the first matching link that has one, entities decoded."""

    def rows(page: str | None) -> list[tuple]:
        targets = [attrs["href"] or "" for attrs, _ in _scan(page, "a", css_class) if "href" in attrs]
        first = targets[0] if targets else None
        return [(first or None, _status(first))]

    return _scanned(df, html, key, "href string, status string", rows)
