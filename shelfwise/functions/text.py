"""Titles, links and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.markup import strip
from shelfwise.site import DEFAULT_SITE, SiteProfile

# What is cut out of a title, in this order.
TITLE_NOISE = [
    r"(?iu)^Highly rated\s*",
    r"(?U)\$[\d,]+\.?\d*\s*\(?\$?\d*\.?\d*/\w+\)?",
    r"(?iU)\d+\.?\d*\s*out\s*of\s*\d+\s*stars?",
    r"(?iU)\d+\s*(ratings?|reviews?)",
    r"(?iU)with\s+\d+\s*(ratings?|reviews?)",
    r"(?iU)(add\s+to\s+cart|buy\s+now|shop\s+now)",
]
TITLE_EDGE_CHARS = ".,;:!?"
NO_TITLE = "Product"


def non_empty(text: Column) -> Column:
    """Null instead of the empty text, so that fallbacks can be coalesced."""
    return F.nullif(text, F.lit(""))


def first_non_empty(*texts: Column) -> Column:
    return F.coalesce(*[non_empty(t) for t in texts], F.lit(""))


def clean_title(title: Column) -> Column:
    cleaned = title
    for noise in TITLE_NOISE:
        cleaned = F.regexp_replace(cleaned, noise, "")
    cleaned = F.btrim(F.regexp_replace(cleaned, r"(?U)\s+", " "))
    cleaned = F.btrim(cleaned, F.lit(TITLE_EDGE_CHARS))
    return F.when(title == "", "").otherwise(F.coalesce(non_empty(cleaned), F.lit(NO_TITLE)))


def title_from_url(url: Column) -> Column:
    """Title-cased slug: what stands after the last '/p/' and before the next '/-'."""
    slug = F.split_part(F.split_part(url, F.lit("/p/"), F.lit(-1)), F.lit("/-"), F.lit(1))
    words = F.initcap(F.translate(slug, "-_", "  "))
    return F.coalesce(non_empty(words), F.lit(NO_TITLE))


def absolute_url(href: Column, site: SiteProfile = DEFAULT_SITE) -> Column:
    return F.concat(F.lit(site.base_url), href)


def clean_url(url: Column) -> Column:
    """Cut at the fragment, then at the query."""
    return F.regexp_replace(url, r"(?s)[#?].*$", "")


def item_number(href: Column) -> Column:
    return F.regexp_extract(href, r"(?U)/A-(\d+)", 1)


def resolve_href(href: Column, base_url: str) -> Column:
    return (
        F.when(href.startswith("/"), F.concat(F.lit(base_url), href))
        .when(href.startswith("http"), href)
        .otherwise(F.concat(F.lit(base_url + "/"), href))
    )


def output_stem(keyword: Column) -> Column:
    """Keyword as a file name: word characters only, runs of '-' and space become '_'."""
    kept = F.regexp_replace(keyword, r"(?U)[^\w\s-]", "")
    return F.lower(F.btrim(F.regexp_replace(kept, r"(?U)[-\s]+", "_"), F.lit("_")))


def output_name(keyword: Column, extension: str) -> Column:
    return F.concat(output_stem(keyword), F.lit(f"_PRODUCTS.{extension}"))


def cache_key(keyword: Column, max_pages: Column) -> Column:
    return F.concat(
        F.lit("search:"), F.lower(strip(keyword)), F.lit(":pages:"), max_pages.cast("string")
    )
