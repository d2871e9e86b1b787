"""Reading HTML with native column expressions.

Every pattern is linear on its input: attribute lists are matched possessively, so a long or
broken tag cannot make the regex engine backtrack.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rest of an open tag: bare text, quoted values, or a stray quote.
ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""

# White space as text trimming understands it (wider than the regex class \s).
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Characters that would change the markup if decoded before the tags are read.
_MARKUP_CHARS = {"<": "lt", ">": "gt", "&": "amp", '"': "quot", "'": "apos"}

# Elements that never have content.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"]

_HIDDEN = r"<!--.*?-->|<(script|style|template)(?=[\s>])" + ATTRS + r">.*?</\1\s*>"


def open_tag(names: str) -> str:
    """Pattern of an open tag with one of the names (a regex alternation)."""
    return rf"<(?:{names})(?=[\s/>]){ATTRS}>"


def _up_to_value(attr: str) -> str:
    """Pattern of everything in a tag between its name and the value of its first such attribute."""
    return (
        rf"""(?:[^>"'\s]++|\s++(?!(?:{attr})\s*+=)|"[^"]*+"|'[^']*+')*+"""
        rf"""\s++(?:{attr})\s*+=\s*+"""
    )


def tag_where(names: str, attr: str, value: str) -> str:
    """Pattern of an open tag whose attribute holds the value pattern (case-sensitive value)."""
    v = rf"(?-i:{value})"
    held = (
        rf'''(?:"[^"]*?{v}[^"]*+"'''
        rf"""|'[^']*?{v}[^']*+'"""
        rf"""|(?!["'])[^\s>]*?{v}[^\s>]*+)"""
    )
    return rf"<(?:{names})(?=[\s/>]){_up_to_value(attr)}{held}{ATTRS}>"


def raw_attr(tag: Column, name: str) -> Column:
    """Attribute as written, of the open tag at the start of the text; '' when absent."""
    value = r"""["']?+((?<=")[^"]*+|(?<=')[^']*+|(?<=[=\s])[^\s>"']++)"""
    return F.regexp_extract(tag, rf"(?is)^<[^\s/>]++{_up_to_value(name)}{value}", 1)


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute of the open tag at the start of the text; '' when absent."""
    return unescape(raw_attr(tag, name))


def unescape(text: Column) -> Column:
    """Decode the five markup entities; `normalise` has decoded all the others."""
    for char, name in (("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos"), ("&", "amp")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def _numeric_entity(piece: Column) -> Column:
    """Character of a '#' reference, as an entity where it would change the markup; else null."""
    decimal = F.regexp_extract(piece, r"^#0*([0-9]{1,7})(?![0-9])", 1)
    hexadecimal = F.regexp_extract(piece, r"^#[xX]0*([0-9a-fA-F]{1,6})(?![0-9a-fA-F])", 1)
    digits = F.when(decimal != "", F.hex(F.nullif(decimal, F.lit("")).cast("bigint"))).otherwise(
        F.upper(hexadecimal)
    )
    padded = F.lpad(digits, 8, "0")
    known = F.when(digits == "", F.lit(None).cast("string"))
    for char, entity in _MARKUP_CHARS.items():
        known = known.when(digits == format(ord(char), "X"), F.lit(f"&{entity};"))
    legal = padded.between("00000001", "0010FFFF") & ~padded.between("0000D800", "0000DFFF")
    return known.when(legal, F.decode(F.unhex(padded), "UTF-32"))


def _entity_text(piece: Column, names: Column) -> Column:
    """Text of what follows one '&': the entity is decoded if it is known, else put back."""
    name = F.regexp_extract(piece, r"^([a-zA-Z][a-zA-Z0-9]*);", 1)
    char = F.when(piece.startswith("#"), _numeric_entity(piece)).otherwise(
        F.when(name != "", F.element_at(names, name))
    )
    after = F.regexp_replace(piece, r"^#?[a-zA-Z0-9]+;?", "")
    return F.coalesce(F.concat(char, after), F.concat(F.lit("&"), piece))


def decode_entities(html_text: Column) -> Column:
    """Decode character references, except those for markup characters, which stay as entities."""
    known = "\u0002".join(
        f"{name}\u0003{chr(code)}"
        for name, code in html.entities.name2codepoint.items()
        if chr(code) not in _MARKUP_CHARS
    )
    names = F.str_to_map(F.lit(known), F.lit("\u0002"), F.lit("\u0003"))
    pieces = F.split(html_text, "&")
    decoded = F.array_join(
        F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(_entity_text(p, names))), ""
    )
    return F.when(F.contains(html_text, F.lit("&")), decoded).otherwise(html_text)


def drop_hidden(html_text: Column) -> Column:
    """Replace comments, styles, templates and plain scripts by an inert tag.

    Scripts of structured data stay: they are read from the markup, never from the text.
    """
    plain = r"script(?![^>]*application/ld\+json)"
    hidden = rf"<!--.*?-->|<(style|template|{plain})(?=[\s>]){ATTRS}>.*?</\1\s*+>"
    return F.regexp_replace(html_text, f"(?is){hidden}", "<!>")


def normalise(html_text: Column) -> Column:
    """The form of a page that all extraction rules read."""
    return drop_hidden(decode_entities(html_text))


def text_nodes(html_text: Column) -> Column:
    """Every tag and every hidden block becomes one U+0001."""
    return F.regexp_replace(html_text, rf"(?is){_HIDDEN}|</?[a-z!?]{ATTRS}>", "\u0001")


def all_strings(html_text: Column) -> Column:
    """Every string of the page, comments and scripts included, with U+0001 between them."""
    return F.regexp_replace(html_text, rf"(?is)<!--|-->|</?[a-z!?]{ATTRS}>", "\u0001")


def raw_text(html_text: Column) -> Column:
    """Text nodes joined as they are."""
    return unescape(F.replace(text_nodes(html_text), F.lit("\u0001"), F.lit("")))


def tight(nodes: Column) -> Column:
    """Text nodes, each trimmed, joined with nothing."""
    return unescape(strip(F.regexp_replace(nodes, rf"{WS}*+\u0001[\u0001{WS[1:]}*+", "")))


def spaced(nodes: Column) -> Column:
    """Text nodes, each trimmed, joined with one space."""
    return unescape(strip(F.regexp_replace(nodes, rf"{WS}*+\u0001[\u0001{WS[1:]}*+", " ")))


def tight_text(html_text: Column) -> Column:
    return tight(text_nodes(html_text))


def spaced_text(html_text: Column) -> Column:
    return spaced(text_nodes(html_text))


def strip(text: Column) -> Column:
    """Trim all white space at both ends."""
    return F.regexp_replace(text, rf"^{WS}++|(?<!{WS}){WS}++$", "")


def is_blank(text: Column) -> Column:
    """Nothing but white space."""
    return text.isNull() | text.rlike(rf"^{WS}*+$")


def first_from(html_text: Column, tag_pattern: str) -> Column:
    """The text from the first tag that matches to the end; '' when there is none."""
    return F.regexp_extract(html_text, f"(?is){tag_pattern}.*+", 0)


def _balanced(rest: Column, name: Column) -> Column:
    """Cut the element that starts the text where its own end tag closes it, at any nesting depth."""
    pieces = F.split(rest, "(?=<)")

    def step(acc: Column, piece: Column) -> Column:
        tag = F.lower(F.regexp_extract(piece, r"^<(/?[a-zA-Z][\w:-]*)", 1))
        depth = (
            acc["depth"]
            + F.when(tag == name, 1).when(tag == F.concat(F.lit("/"), name), -1).otherwise(0)
        )
        return F.when(acc["closed"], acc).otherwise(
            F.struct(
                depth.alias("depth"),
                (
                    acc["length"]
                    + F.when(depth > 0, F.length(piece)).otherwise(F.lit(0))
                ).alias("length"),
                (depth <= 0).alias("closed"),
            )
        )

    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("closed")
    )
    return F.aggregate(pieces, start, step, lambda acc: F.substring(rest, F.lit(1), acc["length"]))


def element(rest: Column) -> Column:
    """The whole element whose open tag starts the text.

    The common case is one regex; nested elements of the same name take the exact way.
    """
    name = F.lower(F.regexp_extract(rest, r"^<([a-zA-Z][\w:-]*)", 1))
    simple = F.regexp_extract(rest, rf"(?is)^<([a-z][\w:-]*+){ATTRS}>.*?</\1\s*>", 0)
    inside = F.lower(F.substring(simple, F.lit(2), F.length(simple)))
    nested = F.contains(inside, F.concat(F.lit("<"), name))
    return (
        F.when(name.isin(VOID_TAGS), F.regexp_extract(rest, f"(?s)^<{ATTRS}>", 0))
        .when((simple != "") & ~nested, simple)
        .otherwise(_balanced(rest, name))
    )


def anchors(html_text: Column) -> Column:
    """All links of a page, in order, each with its content."""
    return F.regexp_extract_all(html_text, F.lit(rf"(?is){open_tag('a')}.*?</a\s*+>"), F.lit(0))


def json_ld(html_text: Column) -> Column:
    """Bodies of all structured-data scripts, in order."""
    script = tag_where("script", "type", r"application/ld\+json")
    return F.regexp_extract_all(html_text, F.lit(rf"(?is){script}(.*?)</script\s*+>"), F.lit(1))
