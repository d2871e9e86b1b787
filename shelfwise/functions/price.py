"""Price rules shared by the card and the detail page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.markup import json_ld
from shelfwise.functions.text import first_non_empty, non_empty

# The patterns and attribute names that mark a price.
PRICE_DATA_TEST = "price"
PRICE_CLASS = "(?:price|cost|amount|dollar|Price)"
PARENT_PRICE_CLASS = "(?:price|cost|amount|Price)"
CARD_PRICE_ATTRIBUTES = ["data-price", "data-current-price", "data-base-price", "price", "data-value"]
DETAIL_PRICE_ATTRIBUTES = ["data-price", "data-current-price", "data-base-price"]
DOLLARS = r"(?U)\$[\d,]+\.?\d*"
OPTIONAL_DOLLARS = r"(?U)\$?[\d,]+\.?\d*"
NUMBER = r"(?U)[\d,]+\.?\d*"
DOLLARS_AND_CENTS = r"(?U)\$[\d,]+\.?\d{2}"
LINK_TEXT_PATTERNS = [
    r"(?U)\$[\d,]+\.?\d{2}",
    r"(?U)\$[\d,]+\.?\d{1}",
    r"(?U)\$[\d,]+",
    r"(?iU)(?:starting|from|price|now)[:\s]*\$?[\d,]+\.?\d*",
    r"(?iU)price[:\s]*\$?[\d,]+\.?\d*",
]


def with_dollar(price: Column) -> Column:
    """Put '$' in front of a non-empty text that does not start with it."""
    return F.regexp_replace(price, r"^(?=[^$])", r"\$")


def attribute_number(value: Column) -> Column:
    return F.regexp_extract(value, OPTIONAL_DOLLARS, 0)


def text_price(text: Column) -> Column:
    """A dollar amount, else the first number taken as dollars."""
    return first_non_empty(
        F.regexp_extract(text, DOLLARS, 0), with_dollar(F.regexp_extract(text, NUMBER, 0))
    )


def link_text_match(text: Column) -> Column:
    """What the first pattern that matches has matched."""
    return first_non_empty(*[F.regexp_extract(text, p, 0) for p in LINK_TEXT_PATTERNS])


def offer_price(html_text: Column) -> Column:
    """`offers.price` of the first structured-data script, if that is a JSON object; else ''."""
    return with_dollar(_offer_price(F.get(json_ld(html_text), F.lit(0))))


def _offer_price(body: Column) -> Column:
    parsed = F.try_parse_json(body)
    price = F.try_variant_get(parsed, "$.offers.price", "string")
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.offers.price", "variant"))
    falsy = (price == "") | ((kind != "STRING") & price.isin("0", "0.0", "false"))
    return F.when(price.isNull() | falsy, "").otherwise(price)


def price_amount(price: Column) -> Column:
    """Numeric form of a price text; null where the text is no number."""
    return F.regexp_replace(non_empty(price), r"[$,]", "").try_cast("decimal(12,2)")
