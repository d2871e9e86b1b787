"""Links of a page together with what stands around them.

Ancestor lookups need the stack of open elements. As a column expression that stack is copied at
every tag, which is quadratic in the page; so this one step is an Arrow-batched function over the
page column. It looks at each page once, keeps only its open elements in memory, and returns the
short pieces of markup that the native title and price rules read. No row leaves its page, so
nothing is shuffled here and no page or site can become a hot group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.price import PARENT_PRICE_CLASS

# Where the ancestor fallbacks look.
TITLE_CONTAINERS = {"div", "article", "section"}
PRICE_CONTAINERS = {"div", "article", "section", "li"}
HEADING_TAGS = {"h2", "h3", "h4", "span"}
HEADING_CLASS = "(?:title|heading|name)"
PRICE_TAGS = {"span", "div"}

_TEXTS = ["opening", "body", "near_heading", "near_price", "container"]
LINKS = T.ArrayType(
    T.StructType(
        [T.StructField("pos", T.IntegerType())] + [T.StructField(n, T.StringType()) for n in _TEXTS]
    )
)

_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
_TAG = re.compile(rf"<(/?)(a|div|article|section|li|ul|ol|span|h[234])(?=[\s/>]){_QUOTED}>", re.I)
_CLASS = re.compile(r"""\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HEADING = re.compile(HEADING_CLASS)
_PRICE = re.compile(PARENT_PRICE_CLASS)


class _Element:
    """An open or closed element of one page."""

    __slots__ = ("tag", "start", "inner", "end", "up", "heading", "price")

    def __init__(self, tag: str, start: int, inner: int, up: _Element | None):
        self.tag, self.start, self.inner, self.end, self.up = tag, start, inner, -1, up
        self.heading = self.price = None

    def nearest(self, tags: set[str]) -> _Element | None:
        box = self.up
        while box is not None and box.tag not in tags:
            box = box.up
        return box


def _close_to(top: _Element | None, tag: str, at: int) -> tuple[_Element | None, bool]:
    """Close the innermost open element with the tag and what is inside it, if there is one."""
    found = top
    while found is not None and found.tag != tag:
        found = found.up
    if found is None:
        return top, False
    while top is not found:
        top.end, top = at, top.up
    found.end = at
    return found.up, True


def links_of(page: str) -> list[_Element]:
    """The links of a page in order; each box knows the first heading and price inside it.

    An end tag closes the innermost open element of its name and whatever is open inside it. A
    link closes an open link, a list item the item just open; the page end closes the rest.
    """
    top: _Element | None = None
    links = []
    for match in _TAG.finditer(page):
        tag, at = match[2].lower(), match.start()
        if match[1]:
            top, _ = _close_to(top, tag, at)
            continue
        if tag == "a" or (tag == "li" and top is not None and top.tag == "li"):
            top, _ = _close_to(top, tag, at)
        element = _Element(tag, at, match.end(), top)
        if tag in HEADING_TAGS or tag in PRICE_TAGS:
            value = _CLASS.search(match[0])
            value = value and (value[1] or value[2] or value[3])
            heading = bool(value) and tag in HEADING_TAGS and bool(_HEADING.search(value))
            price = bool(value) and tag in PRICE_TAGS and bool(_PRICE.search(value))
            # Boxes that hold a hit are a suffix-closed set: stop at the first that has one.
            box = top
            while heading and box is not None and box.heading is None:
                box.heading, box = element, box.up
            box = top
            while price and box is not None and box.price is None:
                box.price, box = element, box.up
        if tag == "a":
            links.append(element)
        top = element
    while top is not None:
        top.end, top = len(page), top.up
    return links


def _surroundings(page: str, pos: int, link: _Element) -> tuple:
    def text(found: _Element | None) -> str | None:
        return None if found is None else page[found.start : found.end]

    box = link.nearest(TITLE_CONTAINERS)
    around = link.nearest(PRICE_CONTAINERS)
    price = around and around.price
    if around is not None and price is None:
        outer = around.nearest(TITLE_CONTAINERS)
        price = outer and outer.price
    return (
        pos,
        page[link.start : link.inner],
        page[link.inner : link.end],
        text(box and box.heading),
        text(price),
        around and around.tag,
    )


@F.arrow_udf(LINKS)
def page_links(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Links of each page with the first heading and price of the boxes around them."""
    for batch in pages:
        rows, offsets = [], [0]
        for page in batch.to_pylist():
            found = links_of(page) if page else []
            rows.extend(_surroundings(page, i, link) for i, link in enumerate(found))
            offsets.append(len(rows))
        columns = list(zip(*rows)) or [[]] * (1 + len(_TEXTS))
        types = [pa.int32()] + [pa.string()] * len(_TEXTS)
        links = pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["pos", *_TEXTS]
        )
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), links)
