"""Landing tables derived from the given `part` and `events` tables.

They stand in for crawled pages and request logs. Every value is a function of the source row, so
the expected results follow from the source columns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import scan
from shelfwise.runtime import spread
from shelfwise.schemas import PRODUCT_COLUMNS
from shelfwise.site import DEFAULT_SITE, SiteProfile

CARDS_PER_PAGE = 24
# Part keys that share one chunk of the page numbering.
KEYS_PER_CHUNK = 4096
DUPLICATE_OFFSET = 10**12
# A page limit above the 20 pages that a request may ask for.
PAGE_LIMIT = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(n: int, remainder: int = 0) -> Column:
    return F.col("k") % n == remainder


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rows with the short names used by the derivations."""
    k = F.col("p_partkey")
    return (
        table(spark, sf_dir, "part")
        .select(
            k.alias("k"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("keyword"),
            F.format_string("%.2f", F.col("p_retailprice")).alias("money"),
        )
        .withColumn(
            "item",
            F.when(_every(17), "")
            .when(_every(13), F.col("k").cast("string"))
            .otherwise((F.col("k") + 10_000_000).cast("string")),
        )
        .withColumn(
            "path",
            F.concat(
                F.lit("/p/"),
                F.replace("name", F.lit(" "), F.lit("-")),
                F.lit("/-"),
                F.when(F.col("item") == "", "").otherwise(F.concat(F.lit("/A-"), "item")),
            ),
        )
    )


# Image forms by k % 4; {i} is the image address.
IMAGE_FORMS = ['<img src="{i}">', '<img data-src="{i}">', '<img srcset="{i} 1x, {i} 2x">', ""]

# Card forms by k % 12: attributes of the link, inside of the link, after the link.
# {N} is the name, {p} the price; the forms exercise every title and price fallback.
CARD_FORMS = [
    ("", '<span data-test="product-title">{N}</span><span data-test="current-price">${p}</span>', ""),
    (' aria-label="{N}" data-price="{p}"', "", ""),
    ("", '<h3 class="card-heading">{N}</h3><span class="price-now">${p}</span>', ""),
    ("", '<h3 class="title">{N}</h3><b>${p}</b>', ""),
    ("", '<h3 class="title">{N}</h3>', '<span class="price">${p}</span>'),
    ("", '<h3 class="title">{N}</h3><i>${p}</i>', ""),
    ("", '<h3 class="title">{N}</h3><i>now {p}</i>', ""),
    (
        "",
        '<h3 class="title">{N}</h3>'
        '<script type="application/ld+json">{"offers":{"price":"{p}"}}</script>',
        "",
    ),
    ("", '<h3 class="title">{N}</h3>', ""),
    ("", "Highly rated {N}${p}($0.71/ounce)4.7 out of 5 stars", ""),
    ("", "", ""),
    ("", "", '<h3 class="title">{N}</h3>'),
]


_CARD = '<div class="card"><a href="{H}"%s>{I}%s</a>%s</div>'


def _form(forms: list[str]) -> Column:
    """The form of the row: forms take turns along the key."""
    return F.get(F.array(*[F.lit(f) for f in forms]), (F.col("k") % len(forms)).cast("int"))


def _fill(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{%s}" % name), value)
    return template


def _card(href: Column) -> Column:
    image = _fill(_form(IMAGE_FORMS), i=F.format_string("https://img.example/%d.jpg", "k"))
    form = _form([_CARD % parts for parts in CARD_FORMS])
    return _fill(form, H=href, I=image, N=F.col("name"), p=F.col("money"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages: 24 parts of a brand per page, the brand being the keyword."""
    suffix = F.when(_every(5, 0), "?ref=x").when(_every(5, 1), "#top").otherwise("")
    numbered = scan.with_row_index(
        parts(spark, sf_dir), ["keyword"], ["k"], F.floor(F.col("k") / KEYS_PER_CHUNK), "seq"
    ).withColumn("page_no", (F.floor(F.col("seq") / CARDS_PER_PAGE) + 1).cast("int"))
    cards = F.concat(
        _card(F.concat("path", suffix)),
        F.when(_every(11), _card(F.concat("path", F.lit("?dup=1")))).otherwise(""),
    )
    pages = (
        numbered.select("keyword", "page_no", "k", cards.alias("card"))
        .groupBy("keyword", "page_no")
        .agg(F.array_sort(F.collect_list(F.struct("k", "card"))).alias("cards"))
    )
    # A page has a next one if that page exists; joined on the key the pages are grouped by.
    followed = numbered.select("keyword", (F.col("page_no") - 1).alias("page_no")).distinct()
    pages = pages.join(followed.withColumn("followed", F.lit(True)), ["keyword", "page_no"], "left")
    nav = F.format_string(
        '<nav><a aria-label="next page" href="/s?q=%s&page=%d">Next</a></nav>',
        F.replace("keyword", F.lit("#"), F.lit("%23")),
        F.col("page_no") + 1,
    )
    return pages.select(
        "keyword",
        "page_no",
        F.concat(
            F.lit("<html><body>"),
            F.array_join(F.col("cards.card"), ""),
            F.when(F.col("followed"), nav).otherwise(""),
            F.lit("</body></html>"),
        ).alias("html"),
    )


def empty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that say that nothing was found: the first, or only the second, of keywords that are no brand."""
    return parts(spark, sf_dir).where(_every(100)).select(
        F.concat(F.lit("none "), F.col("name")).alias("keyword"),
        F.when(_every(200), 1).otherwise(2).alias("page_no"),
        F.lit("<html><body><p>Nothing was found.</p></body></html>").alias("html"),
    ).distinct()


_FILLER = (
    "This text says nothing about the item and is here to make the page long enough to count as a "
    "page with content."
)


# Where the UPC {u} stands, by k % 7; there is no page for 0.
UPC_IN_HEAD = [
    "",
    "",
    "",
    '<meta property="product:upc" content="{u}">',
    '<script type="application/ld+json">{"gtin12":"{u}"}</script>',
    "",
    "",
]
UPC_IN_BODY = [
    "",
    '<section class="Specification"><b>UPC:</b> <span>{u}</span></section>',
    "<dl><dt>UPC</dt><dd>{u}</dd></dl>",
    "",
    "",
    "<p>Universal Product Code: {u}</p>",
    '<span data-upc="{u}"></span>',
]


def detail_pages(
    spark: SparkSession, sf_dir: str, site: SiteProfile = DEFAULT_SITE
) -> DataFrame:
    """Product pages: the UPC stands in one of six places, the price in one of two."""
    rows = spread(parts(spark, sf_dir).where(~_every(7))).withColumn(
        "code", (F.col("k") + 100_000_000_000).cast("string")
    )

    head = _fill(_form(UPC_IN_HEAD), u=F.col("code"))
    body = _fill(_form(UPC_IN_BODY), u=F.col("code"))
    money = F.when(
        _every(2), F.format_string('<span data-test="product-price">$%s</span>', "money")
    ).otherwise(F.format_string("<p>Only $%s today</p>", "money"))
    page = F.concat(
        F.lit("<html><head>"), head, F.lit("</head><body><h1>"), F.col("name"),
        F.lit(f"</h1><p>{_FILLER}</p>"), body, money, F.lit("</body></html>"),
    )
    return rows.select(
        F.concat(F.lit(site.base_url), "path").alias("clean_url"),
        F.when(_every(29), "<html><body>gone</body></html>").otherwise(page).alias("html"),
    )


def products(spark: SparkSession, sf_dir: str, site: SiteProfile = DEFAULT_SITE) -> DataFrame:
    """Product rows with injected faults, so that every validation rule fires."""
    rows = parts(spark, sf_dir)
    title = (
        F.when(_every(37), F.repeat(F.lit("x"), 501))
        .when(_every(23), "")
        .when(_every(19), "ab")
        .otherwise(F.col("name"))
    )
    host = F.when(_every(31), "https://shop.example").otherwise(site.base_url)
    values = {c: F.lit("") for c in PRODUCT_COLUMNS}
    values.update(
        title=title,
        url=F.concat(host, "path"),
        image_url=F.when(_every(4, 3), "").otherwise(
            F.format_string("https://img.example/%d.jpg", F.col("k"))
        ),
        price=F.when((F.col("k") % 12).isin(8, 10, 11), "").otherwise(
            F.concat(F.lit("$"), "money")
        ),
        item_number=F.when(_every(41), "  ").otherwise(F.col("item")),
        marketplace=F.lit(site.marketplace),
        seller_name=F.lit(site.seller_name),
        seller_url=F.lit(site.seller_url),
        seller_business=F.lit(site.seller_business),
        seller_address=F.lit(site.seller_address),
        seller_phone=F.lit(site.seller_phone),
    )
    once = rows.select(
        "keyword",
        F.lit(1).alias("page_no"),
        F.col("k").alias("pos"),
        *[value.alias(name) for name, value in values.items()],
    )
    again = once.where(F.col("pos") % 11 == 0).withColumn(
        "pos", F.col("pos") + F.lit(DUPLICATE_OFFSET)
    )
    return once.unionByName(again)


def _as_timestamp(ts: Column) -> Column:
    return ts.cast("timestamp")


# Event type to job status.
STATUS_OF_EVENT = {
    "signup": "pending",
    "view": "running",
    "click": "retrying",
    "purchase": "completed",
    "error": "failed",
}


def job_events_of(events: DataFrame) -> DataFrame:
    """Job events from an `events` table or stream."""
    status = F.element_at(
        F.create_map(*[F.lit(x) for pair in STATUS_OF_EVENT.items() for x in pair]),
        F.col("event_type"),
    )
    return events.select(
        F.col("user_id").alias("job_id"),
        _as_timestamp(F.col("ts")).alias("ts"),
        "event_id",
        status.alias("status"),
        (F.floor("value") % 101).cast("int").alias("progress"),
        F.concat(F.lit("kw "), (F.col("user_id") % 40).cast("string")).alias("keyword"),
        F.when(status == "failed", "HTTP error").alias("error"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_events_of(table(spark, sf_dir, "events"))


def request_log_of(events: DataFrame) -> DataFrame:
    """Request attempts from an `events` table or stream."""
    digit = F.col("event_id") % 10
    return events.select(
        F.floor(F.col("event_id") / 4).alias("request_id"),
        (F.col("event_id") % 4 + 1).cast("int").alias("attempt"),
        "event_id",
        _as_timestamp(F.col("ts")).alias("ts"),
        F.col("event_type").alias("endpoint"),
        F.concat(F.lit("kw "), (F.col("user_id") % 40).cast("string")).alias("keyword"),
        (F.col("event_id") % 20 + 1).cast("int").alias("max_pages"),
        F.when(digit == 0, 429).when(digit == 1, 500).when(digit == 2, 501).when(digit == 3, 404)
        .otherwise(200).alias("status_code"),
        (F.col("event_id") % 2 == 0).alias("raised"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log_of(table(spark, sf_dir, "events"))
