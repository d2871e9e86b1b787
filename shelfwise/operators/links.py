"""From pages to links: explode, filter, first occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import markup
from shelfwise.site import DEFAULT_SITE


def unnest(rows: DataFrame, others: list[str], array: str) -> DataFrame:
    """One row per struct of an array whose first field is `pos`; rows without any are dropped.

    The outer generator with a filter behind it: a plain one makes the optimizer add a filter on
    the array's size below the generator, which computes the whole array a second time.
    """
    return rows.select(*others, F.inline_outer(array)).where(F.col("pos").isNotNull())


def page_anchors(html: Column) -> Column:
    """All links of a page as (pos, href, block), in page order."""
    return F.transform(
        markup.anchors(markup.normalise(html)),
        lambda a, i: F.struct(
            i.alias("pos"), markup.attr(a, "href").alias("href"), a.alias("block")
        ),
    )


def explode_anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per link: page columns, `pos`, `href`, `block`."""
    others = [c for c in pages.columns if c != html]
    return unnest(pages.select(*others, page_anchors(F.col(html)).alias("links")), others, "links")


def candidate_links(pages: DataFrame, prefix: str = DEFAULT_SITE.product_prefix) -> DataFrame:
    """Links that lead to a product."""
    return explode_anchors(pages).where(F.col("href").startswith(prefix))


def first_occurrences(links: Column) -> Column:
    """Drop links whose href stands earlier in the same page; order is kept."""
    hrefs = links["href"]
    return F.filter(links, lambda x, i: F.array_position(hrefs, x["href"]) == i + 1)


def distinct_links(pages: DataFrame, prefix: str = DEFAULT_SITE.product_prefix) -> DataFrame:
    """First link per page and full URL, query and fragment included.

    A page is one row, so this is decided inside the row; there is no shuffle and no window.
    """
    others = [c for c in pages.columns if c != "html"]
    wanted = pages.select(
        *others,
        F.filter(
            page_anchors(F.col("html")), lambda x: x["href"].startswith(prefix)
        ).alias("links"),
    )
    return unnest(
        wanted.select(*others, first_occurrences(F.col("links")).alias("links")), others, "links"
    )
