"""Search page to product rows: the extraction job."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import markup, nesting, price, text
from shelfwise.functions.nesting import HEADING_CLASS
from shelfwise.operators.links import first_occurrences, unnest
from shelfwise.schemas import PRODUCT_COLUMNS
from shelfwise.site import DEFAULT_SITE, SiteProfile

ANY_TAG = r"[a-z][\w:-]*+"
_OWN_TEXT_TAGS = "span|div|p|strong|b"


def linked_pages(pages: DataFrame, site: SiteProfile = DEFAULT_SITE) -> DataFrame:
    """Pages with `links` in place of their HTML: the distinct product links and their surroundings.

    All steps stay inside the row of the page; only short pieces around links leave it. They are
    separate projections because each one reads the result of the one before several times.
    """
    others = [c for c in pages.columns if c != "html"]
    parsed = pages.select(*others, nesting.page_links(markup.normalise(F.col("html"))).alias("links"))
    wanted = parsed.select(
        *others,
        F.filter(
            F.transform("links", lambda x: x.withField("href", markup.attr(x["opening"], "href"))),
            lambda x: x["href"].startswith(site.product_prefix),
        ).alias("links"),
    )
    return wanted.select(*others, first_occurrences(F.col("links")).alias("links"))


def page_cards(linked: DataFrame) -> DataFrame:
    """One row per product link: page columns, `pos`, `href`, its markup and surroundings."""
    return unnest(linked, [c for c in linked.columns if c != "links"], "links").drop("container")


def _if_has(markup_text: Column, word: str, value: Column) -> Column:
    """A value that can only be non-empty where the markup holds a word, in any case.

    The search for a fixed word is far cheaper than the pattern behind it.
    """
    return F.when(markup_text.rlike(f"(?i){re.escape(word)}"), value).otherwise("")


def _first_where(names: str, attribute: str, value: str) -> Column:
    """The body from its first matching tag on."""
    pattern = markup.tag_where(names, attribute, value)
    return _if_has(F.col("body"), attribute, markup.first_from(F.col("body"), pattern))


def with_title(cards: DataFrame) -> DataFrame:
    """Adds `title` and `title_method` by the ordered fallbacks.

    A marked element ends the search even when it is empty.
    """
    found = (
        cards.withColumn("aria", _if_has(F.col("opening"), "aria-label", markup.attr(F.col("opening"), "aria-label")))
        .withColumn("marked", _first_where(ANY_TAG, "data-test", "title"))
        .withColumn("heading", _first_where("h2|h3|h4", "class", HEADING_CLASS))
        .withColumn("text_nodes", markup.text_nodes(F.col("body")))
        .withColumn("link_text", markup.tight(F.col("text_nodes")))
    )
    method = (
        F.when(F.col("marked") != "", "data-test")
        .when(F.col("heading") != "", "heading")
        .when(F.length("aria") > 5, "aria-label")
        .when(F.col("link_text") != "", "text")
        .when(F.col("near_heading").isNotNull(), "parent")
        .otherwise("url")
    )
    chosen = found.withColumn("title_method", method)
    source = F.when(
        F.col("title_method").isin("data-test", "heading"),
        markup.element(
            F.when(F.col("title_method") == "data-test", F.col("marked")).otherwise(F.col("heading"))
        ),
    ).when(F.col("title_method") == "parent", F.col("near_heading"))
    plain = (
        F.when(F.col("title_method") == "aria-label", F.col("aria"))
        .when(F.col("title_method") == "text", F.col("link_text"))
        .otherwise(markup.tight_text(F.col("title_source")))
    )
    return (
        chosen.withColumn("title_source", source)
        .withColumn("plain_title", plain)
        .withColumn(
            "title",
            F.when(F.col("title_method") == "url", text.title_from_url(F.col("href"))).otherwise(
                text.clean_title(F.col("plain_title"))
            ),
        )
        .drop("aria", "marked", "heading", "link_text", "title_source", "plain_title")
    )


def _own_text_price(body: Column) -> Column:
    """First element whose only content, through only children, is one text with a dollar amount."""
    any_open, any_close = rf"<{ANY_TAG}(?=[\s/>]){markup.ATTRS}>", r"</[a-z][\w:-]*+\s*+>"
    money = r"[^<]*?\$[\d,]+\.?\d*[^<]*+"
    shapes = "|".join(
        f"{any_open * depth}{money}{any_close * depth}" for depth in range(4)
    )
    return F.regexp_extract(
        body, rf"(?is)<({_OWN_TEXT_TAGS})(?=[\s/>]){markup.ATTRS}>({shapes})</\1\s*+>", 2
    )


def with_price(cards: DataFrame) -> DataFrame:
    """Adds `price` and `price_method` by the ordered methods; needs the link columns of `with_title`."""
    attribute = text.first_non_empty(
        *[
            _if_has(
                F.col("opening"), a, price.attribute_number(markup.raw_attr(F.col("opening"), a))
            )
            for a in price.CARD_PRICE_ATTRIBUTES
        ]
    )
    own_text = F.regexp_extract(_own_text_price(F.col("body")), price.DOLLARS, 0)
    looked = (
        cards.withColumn("marked", _first_where(ANY_TAG, "data-test", price.PRICE_DATA_TEST))
        .withColumn("attribute", attribute)
        .withColumn("classed", _first_where("span|div", "class", price.PRICE_CLASS))
        .withColumn("own_text", _if_has(F.col("body"), "$", own_text))
        .withColumn("spaced", markup.spaced(F.col("text_nodes")))
    )
    # The first hit decides where to look; 'link' and 'none' mean that no element was found.
    place = (
        F.when(F.col("marked") != "", "data-test")
        .when(F.col("attribute") != "", "attribute")
        .when(F.col("classed") != "", "class")
        .when(F.col("own_text") != "", "own-text")
        .when(F.col("near_price").isNotNull(), "parent")
        .otherwise("link")
    )
    placed = looked.withColumn("place", place)
    source = F.when(
        F.col("place").isin("data-test", "class"),
        markup.element(
            F.when(F.col("place") == "data-test", F.col("marked")).otherwise(F.col("classed"))
        ),
    ).when(F.col("place") == "parent", F.col("near_price"))
    matched = F.when(F.col("place") == "link", price.link_text_match(F.col("spaced"))).otherwise(
        markup.tight_text(F.col("source"))
    )
    here = (
        F.when(F.col("place") == "attribute", price.with_dollar(F.col("attribute")))
        .when(F.col("place") == "own-text", F.col("own_text"))
        .otherwise(price.text_price(F.col("matched")))
    )
    resolved = (
        placed.withColumn("source", source)
        .withColumn("matched", matched)
        .withColumn("here", here)
        .withColumn(
            "full_text",
            F.when(F.col("here") != "", "").otherwise(
                F.regexp_extract("spaced", price.DOLLARS_AND_CENTS, 0)
            ),
        )
        .withColumn(
            "offer",
            F.when((F.col("here") != "") | (F.col("full_text") != ""), "").otherwise(
                _if_has(F.col("body"), "ld+json", price.offer_price(F.col("body")))
            ),
        )
    )
    method = (
        F.when((F.col("here") != "") & (F.col("place") == "link"), "link-text")
        .when(F.col("here") != "", F.col("place"))
        .when(F.col("full_text") != "", "full-text")
        .when(F.col("offer") != "", "json-ld")
        .otherwise("")
    )
    return (
        resolved.withColumn("price_method", method)
        .withColumn(
            "price",
            text.first_non_empty(F.col("here"), F.col("full_text"), F.col("offer")),
        )
        .drop(
            "text_nodes", "marked", "attribute", "classed", "own_text", "spaced", "place", "source",
            "matched", "here", "full_text", "offer",
        )
    )


def image_url(body: Column) -> Column:
    """First image of the link: its source, lazy source, or first of its source set."""
    img = F.regexp_extract(body, f"(?is){markup.open_tag('img')}", 0)
    return text.first_non_empty(
        markup.attr(img, "src"),
        markup.attr(img, "data-src"),
        F.regexp_extract(markup.attr(img, "srcset"), r"([^\s,]+)", 1),
    )


def product_columns(site: SiteProfile = DEFAULT_SITE) -> dict[str, Column]:
    """The 18 product fields of a card; what no rule fills is the empty text."""
    values = {c: F.lit("") for c in PRODUCT_COLUMNS}
    values.update(
        title=F.col("title"),
        url=text.clean_url(text.absolute_url(F.col("href"), site)),
        image_url=image_url(F.col("body")),
        price=F.col("price"),
        item_number=text.item_number(F.col("href")),
        marketplace=F.lit(site.marketplace),
        seller_name=F.lit(site.seller_name),
        seller_url=F.lit(site.seller_url),
        seller_business=F.lit(site.seller_business),
        seller_address=F.lit(site.seller_address),
        seller_email=F.lit(site.seller_email),
        seller_phone=F.lit(site.seller_phone),
    )
    return values


def products_of(linked: DataFrame, site: SiteProfile = DEFAULT_SITE) -> DataFrame:
    """Linked pages to product rows: page columns, `pos`, the 18 fields and the methods that won."""
    others = [c for c in linked.columns if c != "links"]
    return with_price(with_title(page_cards(linked))).select(
        *others,
        "pos",
        *[value.alias(name) for name, value in product_columns(site).items()],
        "title_method",
        "price_method",
    )


def extract_products(pages: DataFrame, site: SiteProfile = DEFAULT_SITE) -> DataFrame:
    """Search pages to product rows."""
    return products_of(linked_pages(pages, site), site)
