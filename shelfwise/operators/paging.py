"""Page numbers, next links, and which pages of a keyword count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import markup, text
from shelfwise.operators import scan
from shelfwise.site import DEFAULT_SITE

# Pages of a request without a number, and the most a request may ask for.
DEFAULT_MAX_PAGES, MAX_PAGES_LIMIT = 5, 20

# What marks a link to the next page, in order.
NEXT_LINK_MARKS = [
    ("aria-label", r"(?i)next"),
    ("class", r"(?i)next"),
    ("aria-label", r"(?iU)page\s*\d+"),
    ("data-test", r"(?i)next"),
]
NEXT_WORDS = r"next|>|→"
PAGE_LINK = r"(?U)page|p=\d+"
PAGE_IN_LINK = r"(?iU)page[=/-](\d+)|p[=/-](\d+)"
PAGE_IN_TEXT = r"(?iU)page\s*(\d+)"


def page_number(html: Column) -> Column:
    """First 'page n' inside one string of the page, hidden ones included; null when there is none."""
    strings = markup.unescape(markup.all_strings(markup.decode_entities(html)))
    return F.nullif(F.regexp_extract(strings, PAGE_IN_TEXT, 1), F.lit("")).try_cast("bigint")


def _page_links(html: Column) -> Column:
    """Links of a page with what the paging rules read."""
    return F.transform(
        markup.anchors(markup.normalise(html)),
        lambda a, i: F.struct(
            i.alias("pos"),
            a.alias("block"),
            markup.attr(a, "href").alias("href"),
        ),
    )


def _mark(block: Column) -> Column:
    """Rank of the first mark the link has; null when it has none."""
    rank = None
    for n, (name, pattern) in enumerate(NEXT_LINK_MARKS):
        has = markup.attr(block, name).rlike(pattern)
        rank = F.when(has, n) if rank is None else rank.when(has, n)
    return rank


def _linked_page(href: Column) -> Column:
    """Page number in a link; null when there is none."""
    number = text.first_non_empty(
        F.regexp_extract(href, PAGE_IN_LINK, 1), F.regexp_extract(href, PAGE_IN_LINK, 2)
    )
    return F.when(href.rlike(PAGE_LINK), text.non_empty(number).try_cast("bigint"))


def _marked_next(links: Column) -> Column:
    """Marked links that read like 'next', best mark first, then page order."""
    return F.array_sort(
        F.filter(
            F.transform(
                F.filter(
                    links,
                    lambda x: (x["href"] != "")
                    & F.lower(markup.tight_text(x["block"])).rlike(NEXT_WORDS),
                ),
                lambda x: F.struct(_mark(x["block"]).alias("rank"), x["pos"], x["href"].alias("href")),
            ),
            lambda x: x["rank"].isNotNull(),
        )
    )


def _numbered(links: Column) -> Column:
    """Links that carry a page number, highest first, then page order."""
    return F.array_sort(
        F.filter(
            F.transform(
                links,
                lambda x: F.struct(
                    (-_linked_page(x["href"])).alias("n"), x["pos"], x["href"].alias("href")
                ),
            ),
            lambda x: x["n"] < 0,
        )
    )


def with_next_href(pages: DataFrame) -> DataFrame:
    """Adds `next_href`: the marked next link, else the link with the highest page number."""
    links = pages.withColumn("links", _page_links(F.col("html")))
    ranked = links.withColumn("marked", _marked_next(F.col("links"))["href"]).withColumn(
        "numbered", _numbered(F.col("links"))["href"]
    )
    return ranked.withColumn(
        "next_href",
        F.coalesce(F.get("marked", F.lit(0)), F.get("numbered", F.lit(0))),
    ).drop("links", "marked", "numbered")


def with_next_page(pages: DataFrame, base_url: str = DEFAULT_SITE.base_url) -> DataFrame:
    """Adds `next_url` (null on a last page) and `has_more`."""
    return (
        with_next_href(pages)
        .withColumn("next_url", text.resolve_href(F.col("next_href"), base_url))
        .withColumn("has_more", F.col("next_href").isNotNull())
        .drop("next_href")
    )


def highest_page_link(pages: DataFrame, base_url: str = DEFAULT_SITE.base_url) -> DataFrame:
    """Adds `highest_url`: the link with the highest page number, first on ties."""
    links = pages.withColumn("links", _page_links(F.col("html")))
    return links.withColumn(
        "highest_url",
        text.resolve_href(F.get(_numbered(F.col("links"))["href"], F.lit(0)), base_url),
    ).drop("links")


def last_pages(pages: DataFrame, max_pages: int | None = DEFAULT_MAX_PAGES) -> DataFrame:
    """Per keyword the last page that counts, 0 for none; needs `page_no` and `has_more`.

    Paging stops after the first page without a next link, before the first missing page, and at
    `max_pages`, if that is given. Each page tells of itself and of the page before it that it has
    a follower; a page that ends is one without a follower or without a next link. So gaps are
    found by one aggregate on (keyword, page): no task sees all pages of a keyword, and neither
    the pages of a keyword nor repeated landings of a page are limited.
    """
    if max_pages is not None and max_pages < 1:
        raise ValueError("max_pages must be at least 1")
    page, first = F.col("page_no").cast("bigint"), F.lit(True)
    told = pages.where((page >= 1) if max_pages is None else page.between(1, max_pages)).select(
        "keyword",
        F.explode(
            F.array(
                F.struct(page.alias("page"), first.alias("here"), (~F.col("has_more")).alias("stops")),
                F.struct((page - 1).alias("page"), F.lit(False).alias("here"), F.lit(False).alias("stops")),
            )
        ).alias("told"),
    )
    by_page = told.groupBy("keyword", "told.page").agg(
        F.bool_or("told.here").alias("here"),
        F.bool_or(F.coalesce("told.stops", F.lit(False))).alias("stops"),
        F.bool_and("told.here").alias("unfollowed"),
    )
    ends = by_page.where("here").groupBy("keyword").agg(
        F.min("page").alias("first"),
        F.min(F.when(F.col("stops") | F.col("unfollowed"), F.col("page"))).alias("end"),
    )
    landed = pages.select("keyword").distinct()
    last = F.when(F.col("first") == 1, F.col("end")).otherwise(0)
    return scan.join_null_safe(landed, ends, ["keyword"], "left").select(
        "keyword", F.coalesce(last, F.lit(0)).cast("int").alias("last_page")
    )


def counted_pages(pages: DataFrame, ends: DataFrame) -> DataFrame:
    """The pages up to the `last_page` of their keyword, given by `ends`.

    Joined on keyword and page: the pages that count are listed per keyword, so the pages of a
    hot keyword are not brought together.
    """
    listed = ends.where(F.col("last_page") >= 1).select(
        "keyword", "last_page", F.explode(F.sequence(F.lit(1), "last_page")).alias("page_no")
    )
    return scan.join_null_safe(pages, listed, ["keyword", "page_no"])


def page_prefix(pages: DataFrame, max_pages: int | None = DEFAULT_MAX_PAGES) -> DataFrame:
    """The pages that count, with `last_page`."""
    return counted_pages(pages, last_pages(pages, max_pages))


def running_total(products: DataFrame) -> DataFrame:
    """Products per page and the running total of the keyword."""
    per_page = products.groupBy("keyword", "page_no").agg(F.count("*").alias("found"))
    totals = scan.before(
        per_page,
        ["keyword"],
        ["page_no"],
        {"earlier": (F.col("found"), scan.SUM)},
    )
    return totals.select(
        "keyword", "page_no", "found", (F.col("earlier") + F.col("found")).alias("running_total")
    )
