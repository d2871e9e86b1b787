"""Extracts the main text of web pages; blocks that a site repeats on most of its pages are its template."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.runtime import staged

# A subtree is template if it stands on at least this share of the pages of its host, and on this many.
SHARE = 0.5
LEAST_PAGES = 5

# A tag whose attributes end where a quote allows it. Runs are possessive: a tag is read once or not at all.
TAG = re.compile(
    r"""<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S
)
TAG_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br img".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"},
                  "td": {"tr", "table"}, "th": {"tr", "table"}}
# What is never text of a page.
UNSEEN = set(
    "head script style noscript template form button select textarea input iframe object embed svg canvas audio video map "
    "datalist title".split()
)
# What is no part of an article: by element, role, and words of class and id.
NEVER = set("nav footer aside dialog menu".split())
ROLES = set(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form "
    "advertisement".split()
)
WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot dfp gdpr nav navbar navigation menu "
    "sidebar side widget footer header masthead breadcrumb breadcrumbs toolbar share sharing social related recommended "
    "recommendations pagination pager popup modal overlay banner notice alert signup login search respond disqus outbrain "
    "taboola skip sponsor sponsors sponsored sponsoring promo promos promoted promotion promotions cookie cookies consent "
    "comment comments commentlist commenting newsletter newsletters subscribe subscription subscriptions".split()
)
# Words that say nothing beside one of the above.
NEUTRAL = set(
    "site page post article global main user reader readers top bottom left right upper lower inner outer box boxes list "
    "block blocks container wrapper wrap section area bar item items content body text panel link links module zone region "
    "unit slot row col column group holder feed title head heading count button buttons icon icons new latest more form "
    "thread reply replies field message msg policy js is has in the and of on by to with primary secondary mobile desktop "
    "fixed sticky floating media network networks follow us bookmarks tools".split()
)
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption b i em strong span a".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "content", "mark", "inside")

    def __init__(self, tag: str, attrs: str, inside: bool):
        self.tag, self.attrs, self.inside = tag, attrs, inside
        self.children: list[Node | str] = []
        self.content = tag in ("article", "main")  # holds or is an article
        self.mark = b""


def parse(html: str) -> Node:
    """Tree of elements. End tags without a start are skipped; open elements end with their parent.

    Every character is read a fixed number of times, also where tags, comments and quotes never end.
    """
    root = Node("html", "", False)
    stack, at, size = [root], 0, len(html)
    open_tags: Counter[str] = Counter()
    ends = {">": True, "]]>": True}  # whether one may still follow

    def find(what: str, start: int) -> int:
        place = html.find(what, start) if ends[what] else -1
        ends[what] = place >= 0
        return place

    def close(depth: int) -> None:
        for node in stack[depth:]:
            open_tags[node.tag] -= 1
        del stack[depth:]

    def say(text: str) -> None:
        if text:
            stack[-1].children.append(text)

    begin = 0
    while True:
        lt = html.find("<", at)
        if lt < 0:
            say(unescape(html[begin:]))
            return root
        following = html[lt + 1 : lt + 2]
        if following in ("!", "?"):
            say(unescape(html[begin:lt]))
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            elif html.startswith("<![CDATA[", lt) and (end := find("]]>", lt)) >= 0:
                say(html[lt + 9 : end])
                at = end + 3
            else:
                end = find(">", lt)
                at = size if end < 0 else end + 1
            begin = at
            continue
        name = TAG_NAME.match(html, lt) if following == "/" or following.isalpha() else None
        if not name:
            at = lt + 1
            continue
        gt = find(">", lt)
        if gt < 0:
            say(unescape(html[begin:]))
            return root
        found = TAG.match(html, lt) if '"' in html[lt:gt] or "'" in html[lt:gt] else None
        say(unescape(html[begin:lt]))
        at = begin = found.end() if found else gt + 1
        tag, attrs = name[1].lower(), found["attrs"] if found else html[name.end() : gt]
        if following == "/":
            if open_tags[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in CLOSES_P:
            # A new block ends an open paragraph, with what is open inside it.
            for i in range(len(stack) - 1, 0, -1) if open_tags["p"] else ():
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in CLOSED_BY_SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or (tag in ("dt", "dd") and stack[i].tag in ("dt", "dd")):
                    close(i)
                    break
                if stack[i].tag in CLOSED_BY_SAME[tag]:
                    break
        node = Node(tag, attrs, stack[-1].inside or tag in ("article", "main"))
        stack[-1].children.append(node)
        if node.content:
            for parent in reversed(stack):
                if parent.content:
                    break
                parent.content = True
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if tag in ("textarea", "title"):
                node.children.append(unescape(html[at : end.start() if end else size]))
            at = begin = end.end() if end else size
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            stack.append(node)
            open_tags[tag] += 1


def _attributes(node: Node) -> dict[str, str]:
    if not node.attrs.strip(" \t\r\n\f/"):
        return {}
    return {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(node.attrs)}


def hidden(node: Node) -> bool:
    """What no reader sees, whatever a site is like: scripts, styles, forms, hidden elements."""
    if node.tag in UNSEEN:
        return True
    if not node.attrs:
        return False
    attrs = _attributes(node)
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")


def boilerplate(node: Node) -> bool:
    """Whether the element is by its own name, role or class no part of an article.

    A fallback for what a site does not repeat (adverts, reader comments) and for sites with few pages. A class
    or id counts if one of its names consists of words of the lists alone; it never counts for a text block
    inside an article.
    """
    if hidden(node) or node.tag in NEVER:
        return True
    if node.tag == "header":
        return not node.inside
    attrs = _attributes(node)
    if not attrs:
        return False
    if attrs.get("role", "").lower() in ROLES:
        return True
    if node.tag in ("html", "body", "main") or (node.content and node.tag != "article"):
        return False
    if node.inside and node.tag in TEXT_BLOCKS:
        return False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        telling = [w for w in words if w in WORDS and not (w == "header" and node.inside)]
        if telling and all(w in WORDS or w in NEUTRAL for w in words):
            return True
    return False


def mark(node: Node) -> None:
    """Hash every subtree over tags, classes, ids and text with white space as one space; children first."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(c for c in x.children if isinstance(c, Node))
    for x in reversed(order):
        parts = [x.tag, x.attrs.strip()]
        parts += [" ".join(c.split()) if isinstance(c, str) else c.mark.hex() for c in x.children]
        x.mark = blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest()


def may_be_template(node: Node) -> bool:
    """Not what holds an article, nor text inside one."""
    return not node.content and bool(node.children) and not (node.inside and node.tag in TEXT_BLOCKS) and node.tag not in INLINE


def candidates(node: Node) -> set[int]:
    """Hashes of all subtrees that may be template, menus and footers like any other."""
    mark(node)
    out, todo = set(), [node]
    while todo:
        x = todo.pop()
        if hidden(x):
            continue
        if may_be_template(x):
            out.add(int.from_bytes(x.mark, "big", signed=True))
        todo.extend(c for c in x.children if isinstance(c, Node))
    return out


def main_text(html: str, template: set[int], lists: bool = True) -> str:
    """Blocks of the articles of a page, or of the rest of the page if it has none, without its template."""
    root = parse(html)
    if template:
        mark(root)
        todo = [root]
        while todo:
            x = todo.pop()
            # An empty block in its place keeps apart what stands before and after it.
            x.children = [
                Node("div", "", False)
                if isinstance(c, Node) and may_be_template(c) and int.from_bytes(c.mark, "big", signed=True) in template
                else c
                for c in x.children
            ]
            todo.extend(c for c in x.children if isinstance(c, Node))
    skipped = boilerplate if lists else hidden
    articles, todo = [], [root]
    while todo:
        x = todo.pop()
        if skipped(x):
            continue
        if x.tag == "article":
            articles.append(x)
        else:
            todo.extend(c for c in reversed(x.children) if isinstance(c, Node))
    if not articles:
        todo = [root]
        while todo:
            x = todo.pop()
            if not skipped(x):
                if x.tag == "main":
                    articles.append(x)
                else:
                    todo.extend(c for c in reversed(x.children) if isinstance(c, Node))
    blocks, words = [], []

    def end() -> None:
        if line := " ".join("".join(words).split()):
            blocks.append(line)
        words.clear()

    for article in articles or [root]:
        work: list[Node | str | None] = [article]
        while work:
            x = work.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                words.append(x)
            elif x.tag in ("br", "wbr"):
                words.append(" " if x.tag == "br" else "")
            elif not skipped(x):
                if (
                    template
                    and not x.content
                    and not (x.inside and x.tag in TEXT_BLOCKS)
                    and x.tag not in INLINE
                    and int.from_bytes(x.mark, "big", signed=True) in template
                ):
                    end()
                    continue
                if x.tag not in INLINE:
                    end()
                    work.append(None)
                work.extend(reversed(x.children))
        end()
    return "\n".join(blocks)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, mark) of each subtree; page is a hash of the whole html."""
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            part = batch.slice(low, 500)
            hosts, pages, marks = [], [], []
            for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                found = candidates(parse(html))
                page = int.from_bytes(blake2b(html.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                hosts += [host] * len(found)
                pages += [page] * len(found)
                marks += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(marks, pa.int64())], ["host", "page", "mark"]
            )


def _extractor(lists: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [
                    main_text(html, set(template or ()), lists)
                    for html, template in zip(part["html"].to_pylist(), part["template"].to_pylist(), strict=True)
                ]
                sizes = pa.array(map(len, texts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part["page_id"], part["url"], pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"]
                )

    return run


def host_of(url: str = "url"):
    """Host in lower case, without port and user; empty for a null or relative url."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_templates(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """(host, template): hashes of the subtrees on at least `share` of a host's different pages, and on `least`.

    Equal pages count once: what copies of a page share is no template. A host with very many pages is spread over
    its subtrees and pages, and counts are summed before the shuffle. A list is bounded by the subtrees of a page
    over share.
    """
    keyed = pages.select(host_of().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = keyed.mapInArrow(_subtrees, "host string, page long, mark long")
    on = found.distinct().groupBy("host", "mark").agg(F.count("*").alias("n"))
    whole = keyed.select("host", F.xxhash64("html").alias("page")).distinct()
    sizes = whole.groupBy("host").agg(F.count("*").alias("pages"))
    return (
        on.where(F.col("n") >= least)
        .join(sizes, "host")
        .where(F.col("n") >= share * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("mark").alias("template"))
    )


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES, lists: bool = True) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars.

    Every element subtree is hashed and counted per host; what recurs on many pages of a host is deleted, and the
    blocks of the articles that are left (of the page, if it has none) are its text. lists: also leave out what is
    boilerplate by name, for hosts with few pages and for what differs from page to page. Null html is
    empty and gives an empty text; pages without a url share one host. Repeated rows each give a row. Whole
    pages are read, whatever their length. An empty table gives no rows.
    """
    templates = staged(site_templates(pages, share, least), "templates")
    rows = pages.select(
        F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html"),
        host_of().alias("host"),
    )
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    joined = rows.join(templates, "host", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(_extractor(lists), schema)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all rows of `pages`."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
