"""Main text of web pages by text-to-tag ratios.

The page goes through the standard library's parser as a stream of events. Every block of text is a line; a line's ratio
is its number of characters over the number of tags in it. Ratios are smoothed over neighbouring lines
with a Gaussian, and a two-means clustering of the smoothed ratios gives the threshold above which a line is
content. The content lines point to the region: the articles that hold them, else the main element,
else the smallest element that holds most of their text. All lines of the region are the main text, so a
heading or a short paragraph between long ones stays.

Elements that never hold main text (menus, footers, forms, scripts and so on), and elements whose class,
id or role names them as such, take no part in any of this.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repovigil.llm.common import slices

# HTML element names by role.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = set(
    "head title script style noscript template nav aside footer form button select textarea iframe object svg math canvas "
    "menu dialog audio video map label fieldset".split()
)
_BLOCK = set(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address details summary header hgroup hr br center".split()
)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
# Words in class, id and role that name parts of a page other than its article.
_ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe signup sidebar widget menu navbar nav navigation breadcrumb "
    "breadcrumbs footer header masthead toolbar pagination pager social share sharing login search complementary "
    "contentinfo".split()
)
_OTHER_TEXTS = set("comment comments commentlist disqus respond reply replies related recommended".split())
_LAYOUT = {"with", "has", "no", "without"}  # as in "with-sidebar", which names the rest of the page
_NAMES = re.compile("[a-z0-9]+")
_PORTION = 1 << 16
_SIGMA = 1.0
_MOST = 0.7


class _Element:
    __slots__ = ("tag", "parent", "kind", "out")

    def __init__(self, tag: str, parent: _Element | None, kind: int):
        # kind 0: ordinary, 1: named aside but may hold the article, 2: never main text
        self.tag, self.parent, self.kind = tag, parent, kind
        self.out = kind > 0 or (parent is not None and parent.out)

    def chain(self) -> Iterator[_Element]:
        element: _Element | None = self
        while element is not None:
            yield element
            element = element.parent


class _Lines(HTMLParser):
    """Collects lines: [text, tags, characters in links, element, in a heading]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Element("", None, 0)]
        self.lines: list[tuple[str, int, int, _Element, bool]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0
        self.heading = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.stack[-1], self.heading))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def handle_starttag(self, tag, attrs):
        kind = 2 if tag in _NEVER else 0
        named = [v for k, v in attrs if v and k in ("class", "id", "role")] if attrs else None
        if named and not kind and tag not in ("html", "body"):
            words: set[str] = set()
            for name in " ".join(named).lower().split():
                own = _NAMES.findall(name)
                if not _LAYOUT & {*own}:
                    words.update(own)
            kind = 2 if words & _OTHER_TEXTS else int(bool(words & _ASIDE_WORDS))
        if kind or tag in _BLOCK:
            self.flush()
        self.tags += 1
        if tag in _VOID:
            return
        if tag == "a":
            self.links += 1
            return
        if tag in _HEADINGS:
            self.heading = True
        if tag in ("article", "main") and not kind:
            # an element named aside that holds the article is a part of the page's frame
            for e in self.stack[-1].chain():
                if e.kind == 2:
                    break
                e.kind = 0
            for e in self.stack:
                e.out = e.kind > 0 or (e.parent is not None and e.parent.out)
        # paragraphs, cells and inline elements matter only if they are left out
        if kind or tag in ("article", "main", "section", "div", "header", "body", "td", "table", "blockquote", "ul", "ol"):
            self.stack.append(_Element(tag, self.stack[-1], kind))

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCK:
            self.flush()
        self.tags += 1

    def handle_endtag(self, tag):
        if tag in _BLOCK or tag in _NEVER:
            self.flush()
        elif any(e.tag == tag for e in self.stack[1:]):
            self.flush()
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in _HEADINGS:
            self.heading = False
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def page_lines(html: str) -> list[tuple[str, int, int, _Element, bool]]:
    parser = _Lines()
    try:
        for at in range(0, len(html), _PORTION):
            parser.feed(html[at : at + _PORTION])
        parser.close()
    except AssertionError:  # a broken declaration; as text it does no harm
        parser = _Lines()
        parser.feed(html.replace("<![", "&lt;!["))
        parser.close()
    parser.flush()
    return parser.lines


def smoothed_ratios(lines) -> np.ndarray:
    """Characters per tag of each line, smoothed with a Gaussian over the lines around it."""
    ratio = np.array([len(text) / max(1, tags) for text, tags, *_ in lines], float)
    reach = int(3 * _SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / _SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel, "full")[reach : reach + len(ratio)]
    return np.convolve(ratio, kernel, "full")[reach : reach + len(ratio)] / weight


def content_threshold(ratios: np.ndarray) -> float:
    """The middle between the two clusters of ratios (two-means from the extremes)."""
    low, high = float(ratios.min()), float(ratios.max())
    for _ in range(50):
        cut = (low + high) / 2
        above, below = ratios[ratios >= cut], ratios[ratios < cut]
        if not len(below):
            return cut
        now = float(below.mean()), float(above.mean())
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def _revive(lines) -> None:
    """Without an article or main element, one named aside that holds most of the text is the frame of the page."""
    if any(e.tag in ("article", "main") for line in lines for e in line[3].chain()):
        return
    held: dict[_Element, int] = {}
    total = 0
    for text, _, _, element, _ in lines:
        chain = [*element.chain()]
        if all(e.kind < 2 for e in chain):
            total += len(text)
            for e in chain:
                held[e] = held.get(e, 0) + len(text)
    for e, n in held.items():
        if e.kind == 1 and n > _MOST * total:
            e.kind = 0
    for line in lines:
        for e in [*line[3].chain()][::-1]:
            e.out = e.kind > 0 or (e.parent is not None and e.parent.out)


def _in_header(element: _Element) -> bool:
    return any(e.tag == "header" for e in element.chain())


def main_text(html: str) -> str:
    """The main text: blocks in page order, joined by one space; empty if there is none."""
    found = page_lines(html)
    _revive(found)
    lines = []
    for line in found:
        # of a header only the headings of an article count
        inside = any(e.tag in ("article", "main") for e in line[3].chain())
        if not line[3].out and (not _in_header(line[3]) or (inside and line[4])):
            lines.append(line)
    if not lines:
        return ""
    ratios = smoothed_ratios(lines)
    content = ratios >= content_threshold(ratios)
    for tag in ("article", "main"):
        regions = {
            [e for e in line[3].chain() if e.tag == tag][-1]
            for line, own in zip(lines, content)
            if own and any(e.tag == tag for e in line[3].chain())
        }
        if regions:
            return " ".join(line[0] for line in lines if regions & {*line[3].chain()})
    held: dict[_Element, int] = {}
    for line, own in zip(lines, content):
        if own:
            for e in line[3].chain():
                held[e] = held.get(e, 0) + len(line[0])
    total = max(held.values())
    depth = lambda e: sum(1 for _ in e.chain())
    region = max((e for e, n in held.items() if n >= _MOST * total), key=depth)
    # without an article element, lines that are mostly links are menus
    return " ".join(
        text for text, _, linked, element, _ in lines if region in element.chain() and 2 * linked <= len(text)
    )


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``; null or empty html gives empty text.

    Each page is handled on its own from its whole html; repeated rows are repeated.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return rows.mapInArrow(step, "page_id long, url string, text string, n_chars long")
