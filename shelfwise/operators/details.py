"""Product pages: UPC and price by ordered methods, and the join that enriches products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import markup, price, text
from shelfwise.operators.cards import ANY_TAG
from shelfwise.schemas import PRODUCT_COLUMNS

# A shorter page is an error page.
MIN_PAGE_LENGTH = 100

# Where a UPC may stand and how it is written.
SECTION_TAGS = ["div", "section", "dl"]
SECTION_CLASS = "(?:spec|detail|info|Specification)"
META_PROPERTY = "(?i:product|upc)"
UPC_DIGITS = r"(?U)(\d{8,14})"
UPC_ONLY = r"(?U)^\d{8,14}$"
LABELLED_UPC = r"(?iU)UPC[:\s]+(\d{8,14})"
TEXT_UPC_PATTERNS = [
    LABELLED_UPC,
    r"(?iU)Universal\s+Product\s+Code[:\s]+(\d{8,14})",
    r"(?iU)GTIN[:\s]+(\d{8,14})",
]
UPC_TERMS = ["UPC", "UNIVERSAL PRODUCT CODE"]
JSON_UPC_KEYS = ["gtin", "gtin12", "gtin13", "upc"]


def usable_details(details: DataFrame) -> DataFrame:
    return details.where(F.length("html") >= MIN_PAGE_LENGTH)


def _outer_sections(html: Column) -> Column:
    """Markup of the outermost specification sections, each behind a separator.

    The first section that holds a code is inside, or is, the outermost section around the first
    enclosed code, so the outermost ones are enough.
    """
    names = "|".join(SECTION_TAGS)
    opens = "(?is)^" + markup.tag_where(names, "class", SECTION_CLASS)

    def step(acc: Column, piece: Column) -> Column:
        tag = F.lower(F.regexp_extract(piece, r"^<(/?[a-zA-Z]+)", 1))
        outside = acc["depth"] == 0
        depth = (
            F.when(outside, F.when(piece.rlike(opens), 1).otherwise(0))
            .when(tag == acc["tag"], acc["depth"] + 1)
            .when(tag == F.concat(F.lit("/"), acc["tag"]), acc["depth"] - 1)
            .otherwise(acc["depth"])
        )
        return F.struct(
            depth.alias("depth"),
            F.when(outside, tag).otherwise(acc["tag"]).alias("tag"),
            F.when(depth == 0, acc["kept"])
            .otherwise(F.concat(acc["kept"], F.when(outside, "\u0002").otherwise(""), piece))
            .alias("kept"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("tag"), F.lit("").alias("kept"))
    pieces = F.split(html, rf"(?i)(?=</?(?:{names})[\s/>])")
    return F.aggregate(pieces, start, step, lambda acc: acc["kept"])


_TERM = rf"(?is)<dt(?=[\s>]){markup.ATTRS}>((?:(?!</dt|<dt[\s>]).)*+)"
_DEFINITION = rf"(?is)^<dd(?=[\s>]){markup.ATTRS}>(.*?)(?:</dd|<dt[\s>]|</dl|\z)"


def definition_pairs(html: Column) -> Column:
    """Each term with the next definition of the same list, as (pos, term, definition) texts.

    The page is cut once, before each definition. The terms of a piece belong to the definition that starts the next
    one, but for those in front of a list's end. So each piece is read once, however many terms there are.
    """
    pieces = F.split(html, r"(?i)(?=<dd[\s>])")

    def of_piece(piece: Column, following: Column) -> Column:
        here = F.regexp_replace(piece, r"(?is)^.*</dl", "")
        terms = F.regexp_extract_all(here, F.lit(_TERM), F.lit(1))
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(following.isNull(), none).otherwise(terms).alias("terms"),
            markup.tight_text(F.regexp_extract(following, _DEFINITION, 1)).alias("definition"),
        )

    # A zip, as an index into the pieces would cut the page anew for each of them.
    found = F.zip_with(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), of_piece)
    pairs = F.flatten(
        F.transform(
            found,
            lambda one: F.transform(
                one["terms"],
                lambda term: F.struct(markup.raw_text(term).alias("term"), one["definition"].alias("definition")),
            ),
        )
    )
    return F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), p["term"], p["definition"]))


def _first(values: Column) -> Column:
    return F.coalesce(F.get(F.filter(values, lambda v: v != ""), F.lit(0)), F.lit(""))


def _only_upc(value: Column) -> Column:
    return F.when(value.rlike(UPC_ONLY), value).otherwise("")


def _definition_upc(html: Column) -> Column:
    def upc(pair: Column) -> Column:
        term = F.upper(pair["term"])
        named = F.contains(term, F.lit(UPC_TERMS[0])) | F.contains(term, F.lit(UPC_TERMS[1]))
        return F.when(named, F.regexp_extract(pair["definition"], UPC_DIGITS, 1)).otherwise("")

    return _first(F.transform(definition_pairs(html), upc))


def _meta_upc(html: Column) -> Column:
    tags = F.regexp_extract_all(
        html, F.lit(f"(?is){markup.tag_where('meta', 'property', META_PROPERTY)}"), F.lit(0)
    )
    return _first(
        F.transform(tags, lambda t: F.regexp_extract(markup.attr(t, "content"), UPC_DIGITS, 1))
    )


def _json_upc(html: Column) -> Column:
    """The first key that holds anything decides for its script, even if it is malformed."""

    def upc(body: Column) -> Column:
        parsed = F.try_parse_json(body)
        keys = [F.try_variant_get(parsed, f"$.{k}", "string") for k in JSON_UPC_KEYS]
        return _only_upc(markup.strip(text.first_non_empty(*[F.nullif(k, F.lit("0")) for k in keys])))

    return _first(F.transform(markup.json_ld(html), upc))


def _attribute_upc(html: Column) -> Column:
    tags = F.regexp_extract_all(
        html, F.lit(f"(?is){markup.tag_where(ANY_TAG, 'data-upc', '')}"), F.lit(0)
    )
    return _first(F.transform(tags, lambda t: _only_upc(markup.strip(markup.attr(t, "data-upc")))))


def _where_has(column: str, word: str, value: Column) -> Column:
    return F.when(F.col(column).rlike(f"(?i){word}"), value).otherwise("")


def with_upc(pages: DataFrame) -> DataFrame:
    """Adds `upc` and `upc_method`; reads `markup` and `page_text`."""
    in_section = F.regexp_extract(
        markup.raw_text(_outer_sections(F.col("markup"))), LABELLED_UPC, 1
    )
    ways = {
        "section": F.when(F.col("page_text").rlike(LABELLED_UPC), in_section).otherwise(""),
        "definition": _where_has("markup", "<dt", _definition_upc(F.col("markup"))),
        "meta": _where_has("markup", "<meta", _meta_upc(F.col("markup"))),
        "json-ld": _where_has("markup", r"ld\+json", _json_upc(F.col("markup"))),
        "text": text.first_non_empty(
            *[F.regexp_extract("page_text", p, 1) for p in TEXT_UPC_PATTERNS]
        ),
        "attribute": _where_has("markup", "data-upc", _attribute_upc(F.col("markup"))),
    }
    # The ways are coalesced, so one is tried only when the ones before it have failed. Each hit
    # carries its method as a prefix, which keeps every way in the plan once.
    found = F.coalesce(
        *[
            F.concat(F.lit(method + "\u0002"), text.non_empty(value))
            for method, value in ways.items()
        ],
        F.lit("\u0002"),
    )
    others = pages.columns
    parts = pages.withColumn("found", F.split(found, "\u0002"))
    return parts.select(
        *others, F.get("found", F.lit(1)).alias("upc"), F.get("found", F.lit(0)).alias("upc_method")
    )


def with_detail_price(pages: DataFrame) -> DataFrame:
    """Adds `detail_price` and `detail_price_method`; reads `markup` and `page_text`."""
    attribute = F.coalesce(
        *[
            text.non_empty(
                _where_has(
                    "markup",
                    a,
                    price.attribute_number(
                        markup.attr(
                            F.regexp_extract(
                                "markup", f"(?is){markup.tag_where(ANY_TAG, a, '[0-9,]')}", 0
                            ),
                            a,
                        )
                    ),
                )
            )
            for a in price.DETAIL_PRICE_ATTRIBUTES
        ],
        F.lit(""),
    )
    selected = F.coalesce(
        *[
            text.non_empty(markup.first_from(F.col("markup"), markup.tag_where(ANY_TAG, a, v)))
            for a, v in (("class", "price"), ("class", "Price"), ("id", "price"))
        ],
        F.lit(""),
    )
    looked = pages.withColumn(
        "marked",
        markup.first_from(F.col("markup"), markup.tag_where(ANY_TAG, "data-test", price.PRICE_DATA_TEST)),
    ).withColumn("attribute", F.when(F.col("marked") != "", "").otherwise(attribute))
    placed = looked.withColumn(
        "place",
        F.when(F.col("marked") != "", "data-test")
        .when(F.col("attribute") != "", "attribute")
        .otherwise("selector"),
    ).withColumn("rest", F.when(F.col("place") == "selector", selected).otherwise(F.col("marked")))
    here = F.when(F.col("place") == "attribute", price.with_dollar(F.col("attribute"))).when(
        F.col("rest") != "",
        F.regexp_extract(markup.tight_text(markup.element(F.col("rest"))), price.DOLLARS, 0),
    ).otherwise("")
    return (
        placed.withColumn("here", here)
        .withColumn(
            "anywhere",
            F.when(F.col("here") != "", "").otherwise(
                F.regexp_extract("page_text", price.DOLLARS_AND_CENTS, 0)
            ),
        )
        .withColumn("detail_price", text.first_non_empty(F.col("here"), F.col("anywhere")))
        .withColumn(
            "detail_price_method",
            F.when(F.col("here") != "", F.col("place"))
            .when(F.col("anywhere") != "", "text")
            .otherwise(""),
        )
        .drop("marked", "attribute", "place", "rest", "here", "anywhere")
    )


def extract_details(details: DataFrame) -> DataFrame:
    """Detail pages to (clean_url, upc, upc_method, detail_price, detail_price_method).

    A narrow job: the page text is read once and only these short columns are shuffled later.
    """
    others = [c for c in details.columns if c != "html"]
    read = (
        usable_details(details)
        .select(*others, markup.normalise(F.col("html")).alias("markup"))
        .withColumn("page_text", markup.raw_text(F.col("markup")))
    )
    return with_detail_price(with_upc(read)).drop("markup", "page_text")


def newest_per_url(extracted: DataFrame) -> DataFrame:
    """One row per page URL: of the page that landed last (`landed_at`) where a page landed more than once.

    Pages are reduced after extraction, when their rows are short; each task keeps one row per URL before the
    shuffle. Without `landed_at`, and where two landed at once, the greatest values decide.
    """
    values = [c for c in extracted.columns if c not in ("clean_url", "landed_at")]
    landed = [F.col("landed_at")] if "landed_at" in extracted.columns else []
    newest = F.max_by(F.struct(*values), F.struct(*landed, *values))
    return extracted.groupBy("clean_url").agg(newest.alias("best")).select("clean_url", "best.*")


def enrich(products: DataFrame, extracted: DataFrame) -> DataFrame:
    """Fill UPC, and price where the card had none, from the page of the product's URL.

    A left join on the URL: a product without a page keeps its blanks. The detail side is short
    and has one row per URL, so a URL shared by very many products only makes the product side
    skewed, which the adaptive skew join splits.
    """
    joined = products.withColumnRenamed("upc", "card_upc").join(
        newest_per_url(extracted), F.col("url") == F.col("clean_url"), "left"
    )
    filled = joined.withColumn("upc", text.first_non_empty(F.col("upc"))).withColumn(
        "price", text.first_non_empty(F.col("price"), F.col("detail_price"))
    )
    others = [c for c in products.columns if c not in PRODUCT_COLUMNS]
    return filled.select(*others, *PRODUCT_COLUMNS)
