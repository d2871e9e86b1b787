"""Main text of pages: literal pages, and the site template."""

import time

import pytest

from shelfwise.llm import html

SCHEMA = "page_id long, url string, html string, host string, mark long, template string, n long"


@pytest.fixture
def texts(spark):
    def run(rows, **options):
        df = spark.createDataFrame([(*r, "h", 1, "t", 2) for r in rows], SCHEMA)
        return {r.page_id: r for r in html.extract(df, **options).collect()}

    return run


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two\n  three&nbsp;four</p>five", "one\ntwo three four\nfive"),
        ("<article><h1>A &lt;b&gt;</h1><p>x<br>y <b>z</b>!</p></article>", "A <b>\nx y z!"),
        ("<body><nav>menu</nav><article><header><h1>T</h1></header><p>t</p><footer>f</footer></article><aside>s</aside>", "T\nt"),
        ("<div class='cookie-banner'>c</div><main><p>m</p><div id=comments><p>reader</p></div></main>", "m"),
        ("<article><p>a</p><script>var x = '</p>';</script><style>p{}</style><!-- <p>no</p> --></article>", "a"),
        ("<article><form><p>f</p></form><p hidden>h</p><p style='display: none'>d</p><p>ok</p></article>", "ok"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>a<td>b</table></article>", "1\n2\na\nb"),
        ("<article><p>open <b>never closed<p>next", "open never closed\nnext"),
        ("</p></div>text</span>", "text"),
        ("<article><p>&#x41;&#66;&eacute;&unknown;</p></article>", "ABé&unknown;"),
        ("<article class='news'><p>x</p><div class='sponsored'>s</div></article>", "x"),
        ("<article><p class='commentary'>x</p><p>y</p></article>", "x\ny"),
        ("<article><div id='social-history'><p>x</p></div><div class='search-results-study'>y</div></article>", "x\ny"),
        ("<article><p>x</p><div class='userComments'>c</div><ul id='comment-list-2'><li>c</ul></article>", "x"),
        ("a < b <c d", "a < b <c d"),
        ("<article><p title='a > b'>x</p><p title='>y</p></article>", "x\ny"),
        ("<![CDATA[x]]> <![CDATA[ y <b>z</b>", "x z"),
    ],
)
def test_one_page(page, text):
    root = html.parse(page)
    html.mark(root)
    assert html.main_text(page, set()) == text


def test_subtrees_that_a_site_repeats_go(texts):
    note = "<div><p>Read our rules before you write to us.</p></div>"
    page = "<body><div><p>Own text {0} of this page.</p></div>" + note + "<article><p>Article {0}.</p><div><p>Ask us</p></div></article></body>"
    rows = [(i, "http://A.example:80/x", page.format(i)) for i in range(10)]
    rows += [(100 + i, "https://u@b.example/y", "<body>" + note + f"<p>Only {i}</p></body>") for i in range(2)]
    found = texts(rows)
    assert found[3].text == "Article 3."
    assert found[100].text == "Read our rules before you write to us.\nOnly 0"  # two pages are no template
    assert texts(rows, share=2.0)[3].text == "Article 3.\nAsk us"  # nothing recurs so often


def _site(host, pages):
    """Pages of one site as (html, own text): its menu, footer and notice are built from words of no list."""
    top = f"<div class='zz1'><ul><li><a href='/'>Start of {host}</a><li><a href='/x'>All pages</a></ul></div>"
    side = f"<section><div class='zz2'><h3>About {host}</h3><p>We write things.</p></div></section>"
    end = f"<div class='zz3'><p>Made by {host}</p><p>All rights kept.</p></div>"
    out = []
    for i in range(pages):
        own = [f"Title {i} of {host}", f"First part {i * 7}.", f"Second part {i * 11}."]
        body = f"<div class='zz4'><h1>{own[0]}</h1><p>{own[1]}</p><div><p>{own[2]}</p></div></div>"
        out.append((f"<body>{top}{body}{side}{end}</body>", "\n".join(own)))
    return out


def test_template_deletion_alone_finds_the_text(texts):
    """No list, no article element: only what recurs goes, counted against a plain count of whole blocks."""
    rows, own = [], {}
    for h, (host, pages) in enumerate([("a.example", 12), ("b.example", 7), ("c.example", 3)]):
        for i, (page, text) in enumerate(_site(host, pages)):
            rows.append((h * 100 + i, f"http://{host}/{i}", page))
            own[h * 100 + i] = text
    found = texts(rows, lists=False)
    for page_id, text in own.items():
        if page_id < 200:
            assert found[page_id].text == text
        else:
            assert text in found[page_id].text and "All rights kept." in found[page_id].text  # too few pages


def test_menus_and_footers_of_the_given_pages_go_by_template(spark, sf_dir):
    """With all lists off, text of nav and footer elements survives on no host with enough different pages."""
    import duckdb

    big = duckdb.sql(f"SELECT url, html FROM '{sf_dir}/pages.parquet'").fetchall()
    by_host = {}
    for i in range(60):
        nav = "<nav><a href='/'>Home place</a> <a href='/n'>News place</a></nav>"
        by_host.setdefault(i % 6, []).append((f"http://h{i % 6}.example/{i}", nav + big[i % len(big)][1] + "<footer>End of pages</footer>"))
    rows = [(i, *row) for i, row in enumerate(r for rows in by_host.values() for r in rows)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for row in html.extract(df, lists=False).collect():
        assert "News place" not in row.text and "End of pages" not in row.text


def test_copies_of_a_page_are_no_template(texts):
    page = "<body><div><p>Menu</p></div><div><h1>T</h1><p>Body of the page.</p></div></body>"
    found = texts([(i, "http://d.example/", page) for i in range(50)] + [(60 + i, "http://d.example/", f"<div><p>Other {i}</p></div>") for i in range(4)])
    assert found[7].text == "Menu\nT\nBody of the page."


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a ">', "</b>", "<b>", "<![CDATA[", "<!--", "<article>", "<p>", "&", "<", "<li>", "<div><p>"])
def test_odd_pages_take_linear_time(piece):
    began = time.process_time()
    html.main_text(piece * 100_000, set())
    assert time.process_time() - began < 10


def test_nulls_long_pages_repeats_and_empty_table(texts):
    long = "<article>" + "".join(f"<p>part {i}</p>" for i in range(20000)) + "</article>"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    found = texts([(1, None, None), (2, "relative", ""), (3, None, long), (4, "http://c/", deep), (None, None, "<p>é😀</p>")])
    assert [(found[i].text, found[i].n_chars) for i in (1, 2)] == [("", 0)] * 2
    assert found[3].text == "\n".join(f"part {i}" for i in range(20000))
    assert found[4].text == "deep" and (found[None].text, found[None].n_chars) == ("é😀", 2)
    assert texts([]) == {}


def test_query_gives_every_page_its_article(spark, sf_dir, tables):
    rows = html.op6_html_extraction(spark, sf_dir).collect()
    pages = dict(tables("SELECT page_id, html FROM '{dir}/pages.parquet'"))
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.n_chars == len(r.text) and "<p>" not in r.text
        assert not any(line != " ".join(line.split()) for line in r.text.split("\n"))
