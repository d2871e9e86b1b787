"""Literal pages for the rules that the derived tables do not reach."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import markup, price, text
from shelfwise.operators import cards, details, paging


@pytest.fixture(scope="module")
def extract(spark):
    """All cases go through one job; the key of a case is its HTML."""
    done = {}

    def run(html):
        if html not in done:
            pages = spark.createDataFrame([(h,) for h in CARDS], "page string")
            found = cards.extract_products(pages.withColumn("html", F.col("page"))).collect()
            for case in CARDS:
                done[case] = [r for r in found if r.page == case]
        return done[html]

    return run


A = '<a href="/p/some-thing/-/A-12345678">'
# page, title, title method, price, price method
CASES = [
    # a found element without digits goes on to the structured data
    (f'{A}<h3 class="title">Tea</h3><span class="price">soon</span>'
     '<script type="application/ld+json">{"offers": {"price": 4.5}}</script></a>',
     "Tea", "heading", "$4.5", "json-ld"),
    # a found element without digits goes on to the whole text
    (f'{A}<h3 class="title">Tea</h3><div data-test="price">ask</div><i>$12.99</i></a>',
     "Tea", "heading", "$12.99", "full-text"),
    # the grandparent's price; li counts as a container for prices only
    (f'<div><ul><li>{A}<h2 class="name">Tea</h2></a></li></ul><span class="amount">7</span></div>',
     "Tea", "heading", "$7", "parent"),
    # a blank heading ends the search
    (f'{A}<h3 class="title"> </h3>Green tea</a>', "", "heading", "", ""),
    # entities in text and attributes
    (f'<a href="/p/a/-/A-1" aria-label="Salt &amp; pepper &#8217;n&#x2019; more">x</a>',
     "Salt & pepper ’n’ more", "aria-label", "", ""),
    (f"{A}Fish &lt;fresh&gt; &eacute;t&eacute;</a>", "Fish <fresh> été", "text", "", ""),
    # comments, scripts and styles are no text
    (f"{A}<!-- $1.00 --><style>b{{}}</style>Plain<script>var p='$2.00'</script> cup</a>",
     "Plaincup", "text", "", ""),
    # nested elements of the same name
    (f'{A}<h3 class="title">Tea</h3><span class="price"><span>from</span><span>$3.25</span></span></a>',
     "Tea", "heading", "$3.25", "class"),
    # own text through only children; not when there is other text beside
    (f"{A}<h3 class='title'>Tea</h3><p><i>$6.00</i></p></a>", "Tea", "heading", "$6.00", "own-text"),
    (f"{A}<h3 class='title'>Tea</h3><p><i>$6.00</i> each</p></a>", "Tea", "heading", "$6.00", "link-text"),
    # loose price words
    (f'{A}<h3 class="title">Tea</h3><i>from 5 brands</i></a>', "Tea", "heading", "$5", "link-text"),
    (f'{A}<h3 class="title">Tea</h3><i>you know, this</i></a>', "Tea", "heading", "$,", "link-text"),
    (f'{A}<h3 class="title">Tea</h3><i>Starting at 9.99</i></a>', "Tea", "heading", "", ""),
    # attribute order, and a tag with a bracket inside quotes
    (f'<a title="a > b" data-value="8" data-price="$9" href="/p/x-y/-/A-2"><b>ok then</b></a>',
     "ok then", "text", "$9", "attribute"),
    # invalid structured data gives no price
    (f'{A}<h3 class="title">Tea</h3><script type="application/ld+json">{{"offers": {{"price": 3}},}}</script></a>',
     "Tea", "heading", "", ""),
    # upper-case markup
    ('<DIV><A HREF="/p/up-case/-/A-3"></A><SPAN CLASS="title">Upper</SPAN></DIV>',
     "Upper", "parent", "", ""),
    # a container that is never closed still holds what follows
    (f'<section>{A}</a><div><h4 class="heading">Open', "Open", "parent", "", ""),
    # the nearest container decides, even when an outer one has a heading
    (f'<div><h2 class="title">Outer</h2><div>{A}</a></div></div>', "Some Thing", "url", "", ""),
]
CARDS = [case[0] for case in CASES] + [
    "",
    "no links here",
    f'<a href="/x">no</a><a href="https://a.example/p/q">no</a>{A}one</a>{A}two</a>',
    '<a href="/p/i/-/A-9"><img data-src="lazy.jpg" src="">t</a>'
    '<a href="/p/j/-/A-9"><img srcset=" big.jpg 2x, small.jpg 1x">t</a><a href="/p/k/-/A-9">t</a>',
]


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_card(extract, case):
    html, title, title_method, price, price_method = case
    (row,) = extract(html)
    assert (row.title, row.title_method, row.price, row.price_method) == (
        title, title_method, price, price_method,
    )


def test_pages_without_product_links_give_no_rows(extract):
    assert extract(CARDS[-4]) == [] and extract(CARDS[-3]) == []


def test_links_are_filtered_and_repeats_dropped(extract):
    (row,) = extract(CARDS[-2])
    assert (row.pos, row.title, row.item_number) == (2, "one", "12345678")


def test_images(extract):
    assert [r.image_url for r in extract(CARDS[-1])] == ["lazy.jpg", "big.jpg", ""]


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "title, cleaned",
    [
        ("Highly rated Tea$8.49($0.71/ounce)4.7 out of 5 stars", "Tea"),
        ("Lavazza Coffee with 262 ratings262 reviews", "Lavazza Coffee with"),
        ("Tea $8.49", "Tea $8.49"),
        ("  Tea,  add  to cart ", "Tea"),
        ("5 reviews", "Product"),
        ("", ""),
    ],
)
def test_clean_title(spark, title, cleaned):
    assert one(spark, title, text.clean_title) == cleaned


@pytest.mark.parametrize(
    "keyword, name",
    [
        ("Coffee & Tea - 2", "coffee_tea_2_PRODUCTS.csv"),
        ("  --Café crème!", "café_crème_PRODUCTS.csv"),
        ("a_b", "a_b_PRODUCTS.csv"),
    ],
)
def test_output_name(spark, keyword, name):
    assert one(spark, keyword, lambda k: text.output_name(k, "csv")) == name


@pytest.mark.parametrize(
    "html, tight, spaced",
    [
        ("<p> a <b>b</b>\n<!-- x --> c</p>", "abc", "a b c"),
        ("a < b &amp;lt; c&nbsp;", "a < b &lt; c", "a < b &lt; c"),
        ("&#0;&unknown; &#60;b&#62; &copy;", "&#0;&unknown; <b> ©", "&#0;&unknown; <b> ©"),
    ],
)
def test_visible_text(spark, html, tight, spaced):
    assert one(spark, html, lambda x: markup.tight_text(markup.normalise(x))) == tight
    assert one(spark, html, lambda x: markup.spaced_text(markup.normalise(x))) == spaced


PAD = "<p>" + "padding " * 20 + "</p>"
DETAILS = [
    # a section later in the page beats text before it
    ("UPC: 11111111" + PAD + '<div class="x-details"><div>a</div>UPC 22222222</div>', "22222222", "section"),
    # text after a section does not count as inside
    (PAD + '<div class="info"><div>a</div></div>UPC: 33333333', "33333333", "text"),
    # a term's own list, other terms in between
    (PAD + "<dl><dt>UPC code<dt>Size<dd>id 44444444 x</dl>", "44444444", "definition"),
    (PAD + "<dl><dt>UPC</dt></dl><dl><dd>55555555</dd></dl><p data-upc=' 66666666 '></p>", "66666666", "attribute"),
    # the first key that holds anything decides for its script; the next script is still read
    (PAD + '<script type="application/ld+json">{"gtin": "bad", "upc": "77777777"}</script>'
     '<script type="application/ld+json">{"gtin": "", "gtin13": 8888888888888}</script>', "8888888888888", "json-ld"),
    (PAD + '<script type="application/ld+json">[{"upc": "77777777"}]</script>GTIN 99999999', "99999999", "text"),
    (PAD + '<meta property="product:id" content="no 123456789012345">', "12345678901234", "meta"),
    (PAD, "", ""),
]


def test_upc_rules(spark):
    pages = spark.createDataFrame([(str(i), d[0]) for i, d in enumerate(DETAILS)], "clean_url string, html string")
    found = {int(r.clean_url): (r.upc, r.upc_method) for r in details.extract_details(pages).collect()}
    assert found == {i: (d[1], d[2]) for i, d in enumerate(DETAILS)}


PRICES = [
    (PAD + '<b id="main-price">was</b><i>$5.00</i>', "$5.00", "text"),
    (PAD + '<b data-current-price="3,000.5">x</b>', "$3,000.5", "attribute"),
    (PAD + '<b id="price-2"><i>now</i> $7</b>$8.00', "$7", "selector"),
    (PAD + '<b class="big Price">$6</b><b data-test="current-price">none</b>$9.00', "$9.00", "text"),
    (PAD + "costs $4", "", ""),
]


def test_detail_price_rules(spark):
    pages = spark.createDataFrame([(str(i), d[0]) for i, d in enumerate(PRICES)], "clean_url string, html string")
    rows = details.extract_details(pages).collect()
    found = {int(r.clean_url): (r.detail_price, r.detail_price_method) for r in rows}
    assert found == {i: (d[1], d[2]) for i, d in enumerate(PRICES)}


def test_short_pages_are_not_read_and_pages_are_landed_twice(spark):
    products = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    products = products.select(
        F.lit("k").alias("keyword"), F.lit(1).alias("page_no"), F.lit(0).alias("pos"), "url",
        *[F.lit("").alias(c) for c in cards.PRODUCT_COLUMNS if c != "url"],
    )
    page = PAD + "UPC: 11111111 for $2.50"
    landed = spark.createDataFrame([("u", page), ("u", page), ("v", "UPC: 22222222")], "clean_url string, html string")
    rows = details.enrich(products, details.extract_details(landed)).collect()
    assert sorted((r.url, r.upc, r.price) for r in rows) == [("u", "11111111", "$2.50"), ("v", "", ""), ("w", "", "")]


NEXT = [
    ('<a href="/s?page=2">2</a><a class="btn-Next" href="n">Next →</a>', "https://www.target.com/n"),
    ('<a aria-label="page 3" href="/3">&gt;</a><a data-test="next" href="/4">next</a>', "https://www.target.com/3"),
    ('<a aria-label="next" href="">next</a><a href="https://o.example/p-7/page">x</a>', "https://o.example/p-7/page"),
    ('<a href="/page/2">2</a><a href="/q?p=9">9</a><a href="/page-9">9</a>', "https://www.target.com/q?p=9"),
    ('<a aria-label="next" href="/5">more</a>', None),
    ("", None),
]


def test_next_page(spark):
    pages = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NEXT)], "i int, html string")
    found = {r.i: r.next_url for r in paging.with_next_page(pages).collect()}
    assert found == {i: n[1] for i, n in enumerate(NEXT)}


@pytest.mark.parametrize(
    "html, number",
    [("<b>Page  12</b> of 30", 12), ("<!-- page 4 --><p>page 5", 4), ("<p>page</p>7", None), ("", None)],
)
def test_page_number(spark, html, number):
    assert one(spark, html, paging.page_number) == number


@pytest.mark.parametrize("shown, amount", [("$1,234.50", "1234.50"), ("$,", None), ("", None), ("$9", "9.00")])
def test_price_amount(spark, shown, amount):
    found = one(spark, shown, price.price_amount)
    assert (None if found is None else str(found)) == amount
