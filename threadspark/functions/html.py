"""HTML -> text column functions (paragraphs, source text, clean-up).

All functions build native Spark Column expressions (regular expressions and
higher-order array functions); no Python runs per row.

Rules, per ``<p>`` element of a page or comment body:

* ``<span>`` / ``<div>`` elements inside the paragraph are dropped with their content, nested
  ones included; an element without an end tag runs to the end of the paragraph;
* ``<a href=h>text</a>`` becomes ``[text](h)`` when its text is non-empty, else it is dropped;
  the link text is the concatenation of its stripped text pieces;
* ``<em>text</em>`` becomes ``*text*``;
* the remaining text pieces (split at every tag and around each replacement) are
  stripped, empty pieces dropped, and the rest joined with one space.

A paragraph ends at ``</p>`` or at the next ``<p>`` (HTML5 rule for unclosed ``<p>``).
Script, style and comment sections are removed first, and character references are
decoded once, after tag splitting.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space set of Python's str.strip()/str.isspace().
WS = (
    r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# A tag, tolerating '>' inside quoted attribute values. The alternatives start with
# disjoint characters, so possessive quantifiers match the same strings while keeping
# Java's matcher from recursing once per character on long inputs.
ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TAG = "<" + ATTRS + ">"
MARK = "\x01"  # boundary between text pieces produced by replacements
MARK_RE = r"\x01"

NOISE_RE = r"(?is)<!--.*?(?:-->|\z)|<script\b" + ATTRS + r">.*?(?:</script\s*>|\z)|<style\b" + ATTRS + r">.*?(?:</style\s*>|\z)"
P_OPEN_RE = r"(?i)<p(?:\s" + ATTRS + r")?>"
P_CLOSE_TAIL_RE = r"(?is)</p\s*>.*"
# Elements dropped from a paragraph: those holding text only, and the places of the remaining tags.
DROP_LEAF_RE = (
    r"(?is)<(?:span|div)\b[^<>]*/>|<span\b" + ATTRS + r">[^<]*+</span\s*>|<div\b" + ATTRS + r">[^<]*+</div\s*>"
)
DROP_SPLIT_RE = r"(?i)(?=</?(?:span|div)\b)"
DROP_TAG_RE = r"(?i)^</?(span|div)\b"
A_SPLIT_RE = r"(?i)<a\b"
EM_SPLIT_RE = r"(?i)<em\b"
HEAD_RE = r"(?s)^(" + ATTRS + r")>"
HREF_RE = r"""(?is)(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
STRIP_RE = r"\A" + WS + r"+|" + WS + r"+\z"
# The part of a character reference after its '&': hexadecimal, decimal or named.
REFERENCE_RE = r"^(?:#[xX]0*+([0-9a-fA-F]*+)|#0*+([0-9]*+)|([A-Za-z][A-Za-z0-9]*+;?));?"
NUMERIC_RE = r"^#(?:[0-9]|[xX][0-9a-fA-F])"
# The references met most, tried before the whole table.
COMMON = ["amp;", "lt;", "gt;", "quot;", "nbsp;"]
# References 128 to 159 mean the windows-1252 character at that byte (U+FFFD where there is none).
WINDOWS_1252 = [bytes([b]).decode("cp1252", errors="replace") for b in range(0x80, 0xA0)]


def _tail(arr: Column) -> Column:
    """All elements but the first (``arr`` is referenced once, so it is evaluated once)."""
    return F.filter(arr, lambda x, i: i > 0)


def strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode white space."""
    return F.regexp_replace(c, STRIP_RE, "")


def _number(piece: Column) -> Column:
    """Character of a numeric reference (U+FFFD for zero, surrogates and numbers beyond Unicode)."""
    # Leading zeros are gone, so seven hexadecimal or eight decimal digits already lie beyond Unicode.
    hexa = F.substring(F.regexp_extract(piece, REFERENCE_RE, 1), 1, 7)
    deci = F.substring(F.regexp_extract(piece, REFERENCE_RE, 2), 1, 8)
    n = F.coalesce(F.when(hexa != "", F.conv(hexa, 16, 10)).otherwise(deci).try_cast("int"), F.lit(0))
    return (
        F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(n.between(0x80, 0x9F), F.try_element_at(F.array(*[F.lit(c) for c in WINDOWS_1252]), n - 0x7F))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def _name(piece: Column) -> Column:
    """Characters of a named reference (null for an unknown name)."""
    key = F.regexp_extract(piece, REFERENCE_RE, 3)
    table = F.str_to_map(
        F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in html5.items())), F.lit("\x1e"), F.lit("\x1f")
    )
    common = F.when(key == "", F.lit(None).cast("string"))
    for k in COMMON:
        common = common.when(key == k, F.lit(html5[k]))
    return common.otherwise(F.try_element_at(table, key))


def decode_entities(c: Column) -> Column:
    """HTML character references -> characters, each decoded once (``&amp;lt;`` gives ``&lt;``).

    All named references of HTML 5 (the ones allowed without ``;`` too, when the whole word is
    the name) and all numeric ones; anything else stays as it is.
    """

    def one(piece: Column) -> Column:
        rest = F.regexp_replace(piece, REFERENCE_RE, "")
        decoded = F.when(piece.rlike(NUMERIC_RE), _number(piece)).otherwise(_name(piece))
        return F.coalesce(F.concat(decoded, rest), F.concat(F.lit("&"), piece))

    parts = F.transform(F.split(c, "&", -1), lambda x, i: F.when(i == 0, x).otherwise(one(x)))
    return F.when(c.contains("&"), F.array_join(parts, "")).otherwise(c)


def _drop_elements(body: Column) -> Column:
    """``body`` without its ``span`` and ``div`` elements, nested ones included.

    Elements holding text only go in one regular-expression pass; what is left is cut before
    each remaining span or div tag, and a running (name, depth) of the outermost open
    element tells which pieces stay.
    """

    def step(acc: Column, piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, DROP_TAG_RE, 1))
        change = F.when(piece.startswith("</"), -1).otherwise(1)
        inside = acc["depth"] > 0
        depth = (
            F.when(inside & (name == acc["name"]), acc["depth"] + change)
            .when(inside, acc["depth"])
            .when((name != "") & (change > 0), 1)
            .otherwise(0)
        )
        rest = F.when(name == "", piece).otherwise(F.regexp_replace(piece, "^" + TAG, MARK))
        return F.struct(
            F.when(inside, acc["name"]).otherwise(name).alias("name"),
            depth.alias("depth"),
            F.when(depth == 0, F.array_append(acc["kept"], rest)).otherwise(acc["kept"]).alias("kept"),
        )

    start = F.struct(F.lit("").alias("name"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))
    pieces = F.split(F.regexp_replace(body, DROP_LEAF_RE, MARK), DROP_SPLIT_RE, -1)
    return F.aggregate(pieces, start, step, lambda acc: F.array_join(acc["kept"], ""))


def _element_pieces(body: Column, split_re: str, close_tag: str, render) -> Column:
    """Rewrite every ``<x ...>inner</x>`` of ``body`` via ``render(attrs, inner)``.

    ``body`` is split at each opening tag; every piece after the first starts
    with the tag's attributes. An element without a closing tag runs to the
    end of its piece.
    """
    parts = F.split(body, split_re, -1)
    close_re = r"(?is)^" + ATTRS + r">.*?</" + close_tag + r"\s*>"

    def one(piece: Column) -> Column:
        closed = piece.rlike(close_re)
        attrs = F.regexp_extract(piece, HEAD_RE, 1)
        inner = F.when(
            closed, F.regexp_extract(piece, r"(?is)^" + ATTRS + r">(.*?)</" + close_tag + r"\s*>", 1)
        ).otherwise(F.regexp_extract(piece, r"(?s)^" + ATTRS + r">(.*)", 1))
        rest = F.when(closed, F.regexp_replace(piece, close_re, "")).otherwise(F.lit(""))
        return render(attrs, inner, rest)

    # one pass over the pieces: the first is kept as is, every later one is rendered
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(one(x))), "")


def _joined_text(inner: Column, extra_boundary: str = "") -> Column:
    """``get_text(strip=True)``: stripped text pieces concatenated without separator."""
    pat = WS + "*(?:" + TAG + extra_boundary + ")" + WS + "*"
    return strip(F.regexp_replace(inner, pat, ""))


def _render_link(attrs: Column, inner: Column, rest: Column) -> Column:
    href = F.concat(
        F.regexp_extract(attrs, HREF_RE, 1),
        F.regexp_extract(attrs, HREF_RE, 2),
        F.regexp_extract(attrs, HREF_RE, 3),
    )
    text = _joined_text(inner, "|" + MARK_RE)
    link = F.concat(F.lit(MARK + "["), text, F.lit("]("), href, F.lit(")" + MARK))
    return F.when(text != "", F.concat(link, rest)).otherwise(rest)


def _render_em(attrs: Column, inner: Column, rest: Column) -> Column:
    text = _joined_text(inner, "|" + MARK_RE)
    return F.concat(F.lit(MARK + "*"), text, F.lit("*" + MARK), rest)


def paragraph_text(body: Column) -> Column:
    """Text of one paragraph body (the markup between ``<p>`` and its end)."""
    b = F.when(body.rlike(r"(?i)<(?:span|div)\b"), _drop_elements(body)).otherwise(body)
    b = _element_pieces(b, A_SPLIT_RE, "a", _render_link)
    b = _element_pieces(b, EM_SPLIT_RE, "em", _render_em)
    pieces = F.split(b, TAG + "|" + MARK_RE, -1)
    pieces = F.transform(pieces, lambda x: strip(decode_entities(x)))
    return F.array_join(F.filter(pieces, lambda x: x != ""), " ")


def paragraph_bodies(html: Column) -> Column:
    """ARRAY of raw paragraph bodies of a page, in document order."""
    clean = F.regexp_replace(html, NOISE_RE, "")
    parts = F.split(clean, P_OPEN_RE, -1)
    return F.transform(_tail(parts), lambda x: F.regexp_replace(x, P_CLOSE_TAIL_RE, ""))


def _paragraph(body: Column) -> Column:
    # A body without markup (and without the internal boundary mark) is a single
    # text piece: decoding and stripping it gives the same result without the tag machinery.
    plain = ~body.contains("<") & ~body.contains(MARK)
    return F.when(plain, strip(decode_entities(body))).otherwise(strip(paragraph_text(body)))


def html_to_paragraphs(html: Column) -> Column:
    """ARRAY<STRING> of paragraph texts (empty paragraphs kept as '')."""
    return F.transform(paragraph_bodies(html), _paragraph)


def html_to_source(html: Column) -> Column:
    """Paragraphs joined by newline, stripped, plus the fixed ``\\nhide`` suffix."""
    return F.concat(strip(F.array_join(html_to_paragraphs(html), "\n")), F.lit("\nhide"))


# Trailing markers removed by the clean-up, in this order.
HIDE_SUFFIXES = ["hide", "hide,", "HIDE", "HIDE,"]


def clean_source(text: Column) -> Column:
    """Strip, drop one trailing hide marker of each kind, squeeze one pass of
    blank lines and pull a lone period onto its line."""
    t = strip(text)
    for suffix in HIDE_SUFFIXES:
        t = F.regexp_replace(t, WS + "*" + suffix + r"\z", "")
    t = F.replace(t, F.lit("\n\n"), F.lit("\n"))
    return F.replace(t, F.lit(" .\n"), F.lit(".\n"))


def html_title(html: Column) -> Column:
    """Content of the first ``<title>`` element, entity-decoded and stripped (null if absent)."""
    raw = F.regexp_extract(html, r"(?is)<title\b" + ATTRS + r">(.*?)</title\s*>", 1)
    return F.when(html.rlike(r"(?is)<title\b" + ATTRS + r">.*?</title\s*>"), strip(decode_entities(raw)))


def wrap_paragraphs(text: Column) -> Column:
    """Plain text -> minimal HTML: one ``<p>`` per line."""
    return F.concat(F.lit("<p>"), F.replace(text, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
