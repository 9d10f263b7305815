"""DuckDB SQL expression builders used by the independent oracle queries.

These mirror the semantics documented in :mod:`threadspark.functions.html` and
:mod:`threadspark.functions.text`, written directly in DuckDB's dialect (RE2
regular expressions, ``lambda x: ...`` list functions, 1-based lists).
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

# Patterns written for RE2, apart from those of the functions under test.
SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
ANY_TAG = "<" + ATTRS + ">"
EDGE_SPACE = rf"\A{SPACE}+|{SPACE}+\z"
UNSEEN = (
    rf"(?is)<!--.*?(?:-->|\z)|<script\b{ATTRS}>.*?(?:</script\s*>|\z)|<style\b{ATTRS}>.*?(?:</style\s*>|\z)"
)
PARAGRAPH = rf"(?i)<p(?:\s{ATTRS})?>"
PARAGRAPH_END = r"(?is)</p\s*>.*"
HREF = r"""(?is)(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
ANCHOR = rf"(?is)<a\b{ATTRS}>.*?</a\s*>"

# Named references of the oracles: the HTML 4 names and every name HTML allows without ';'.
NAMED = {f"{n};": chr(c) for n, c in name2codepoint.items()} | {k: v for k, v in html5.items() if not k.endswith(";")}


def q(s: str) -> str:
    """Quote a Python string as a SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(EDGE_SPACE)}, '', 'g')"


def _named(key: str) -> str:
    names = ", ".join(q(k) for k in NAMED)
    values = ", ".join(q(v) for v in NAMED.values())
    return f"([{values}])[list_position([{names}], {key})]"


def decode(x: str) -> str:
    """Character references, one at a time after each '&' (numbers stay within Unicode here)."""
    number = "coalesce(TRY_CAST('0x' || regexp_extract(w, '^#[xX]([0-9a-fA-F]+)', 1) AS INTEGER), TRY_CAST(regexp_extract(w, '^#([0-9]+)', 1) AS INTEGER))"
    name = "regexp_extract(w, '^[A-Za-z][A-Za-z0-9]*;?')"
    one = (
        f"CASE WHEN regexp_matches(w, '^#([0-9]|[xX][0-9a-fA-F])') THEN chr({number}) || regexp_replace(w, '^#[xX]?[0-9a-fA-F]+;?', '') "
        f"ELSE coalesce({_named(name)} || substr(w, length({name}) + 1), '&' || w) END"
    )
    parts = f"string_split({x}, '&')"
    return f"array_to_string(list_transform({parts}, lambda w, i: CASE WHEN i = 1 THEN w ELSE {one} END), '')"


def tail(x: str) -> str:
    return f"({x})[2:]"


def join(lst: str, sep: str) -> str:
    return f"coalesce(array_to_string({lst}, {q(sep)}), '')"


def _joined_text(inner: str) -> str:
    return strip(f"regexp_replace({inner}, {q(rf'{SPACE}*(?:{ANY_TAG}|{chr(1)}){SPACE}*')}, '', 'g')")


def _elements(body: str, tag: str, render, p: str) -> str:
    """Every ``<tag ...>inner</tag>`` of ``body`` through ``render(attrs, inner, rest)``."""
    whole = rf"(?is)^({ATTRS})>(.*?)</{tag}\s*>"
    closed = f"regexp_matches({p}, {q(whole)})"
    attrs = f"regexp_extract({p}, {q(rf'(?s)^({ATTRS})>')}, 1)"
    open_inner = rf"(?s)^{ATTRS}>(.*)"
    inner = f"(CASE WHEN {closed} THEN regexp_extract({p}, {q(whole)}, 2) ELSE regexp_extract({p}, {q(open_inner)}, 1) END)"
    rest = f"(CASE WHEN {closed} THEN regexp_replace({p}, {q(whole)}, '') ELSE '' END)"
    parts = f"string_split_regex({body}, {q(rf'(?i)<{tag}{chr(92)}b')})"
    rendered = render(attrs, inner, rest)
    return f"(({parts})[1] || {join(f'list_transform({tail(parts)}, lambda {p}: {rendered})', '')})"


def _render_link(attrs: str, inner: str, rest: str) -> str:
    text = _joined_text(inner)
    href = " || ".join(f"regexp_extract({attrs}, {q(HREF)}, {i})" for i in (1, 2, 3))
    return f"(CASE WHEN {text} <> '' THEN chr(1) || '[' || {text} || '](' || {href} || ')' || chr(1) || {rest} ELSE {rest} END)"


def _render_em(attrs: str, inner: str, rest: str) -> str:
    return f"(chr(1) || '*' || {_joined_text(inner)} || '*' || chr(1) || {rest})"


def without_elements(body: str) -> str:
    """``body`` without span and div elements: the innermost ones per pass, four passes (the oracle's
    pages nest at most four deep, and their tags inside such elements start with other letters than s and d)."""
    innermost = "|".join(rf"<{tag}\b{ATTRS}>(?:[^<]|</?[^sd/])*</{tag}\s*>" for tag in ("span", "div"))
    for _ in range(4):
        body = f"regexp_replace({body}, {q('(?is)' + innermost)}, chr(1), 'g')"
    return body


def paragraph_text(body: str) -> str:
    b = _elements(without_elements(body), "a", _render_link, "pa")
    b = _elements(b, "em", _render_em, "pe")
    pieces = f"string_split_regex({b}, {q(ANY_TAG + '|' + chr(1))})"
    return join(f"list_filter(list_transform({pieces}, lambda t: {strip(decode('t'))}), lambda t: t <> '')", " ")


def paragraph_bodies(html: str) -> str:
    clean = f"regexp_replace({html}, {q(UNSEEN)}, '', 'g')"
    parts = f"string_split_regex({clean}, {q(PARAGRAPH)})"
    return f"list_transform({tail(parts)}, lambda x: regexp_replace(x, {q(PARAGRAPH_END)}, ''))"


def html_to_paragraphs(html: str) -> str:
    return f"list_transform({paragraph_bodies(html)}, lambda b: {strip(paragraph_text('b'))})"


def html_to_source(html: str) -> str:
    return f"({strip(join(html_to_paragraphs(html), chr(10)))} || chr(10) || 'hide')"


def clean_source(text: str) -> str:
    t = strip(text)
    for suffix in ("hide", "hide,", "HIDE", "HIDE,"):
        t = f"regexp_replace({t}, {q(SPACE + '*' + suffix + chr(92) + 'z')}, '')"
    t = f"replace({t}, chr(10) || chr(10), chr(10))"
    return f"replace({t}, ' .' || chr(10), '.' || chr(10))"


def html_title(html: str) -> str:
    pat = rf"(?is)<title\b{ATTRS}>(.*?)</title\s*>"
    return f"(CASE WHEN regexp_matches({html}, {q(pat)}) THEN {strip(decode(f'regexp_extract({html}, {q(pat)}, 1)'))} END)"


def wrap_paragraphs(text: str) -> str:
    return f"('<p>' || replace({text}, chr(10), '</p><p>') || '</p>')"


# ---------------------------------------------------------------- text functions
WORD = r"[\p{L}\p{N}_]"
TOKEN = (
    rf"(?i)n't|'(?:s|m|d|ll|re|ve)\b|{WORD}+(?:[-.,']{WORD}+)*|\.\.\.|[^\p{{L}}\p{{N}}_\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]"
)


def tokenize(text: str) -> str:
    t = f"regexp_replace({text}, {q(r"(?i)(\p{L})(n't)\b")}, '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, {q(r"(?i)(\p{L})('(?:s|m|d|ll|re|ve))\b")}, '\\1 \\2', 'g')"
    return f"regexp_extract_all({t}, {q(TOKEN)}, 0)"


def ascii_replace(text: str) -> str:
    return f"regexp_replace({text}, {q(r'[^\x00-\x7F]')}, '?', 'g')"


def nonalnum_distinct(text: str) -> str:
    rest = f"regexp_replace({text}, {q(r'[\p{L}\p{N}]')}, '', 'g')"
    return f"CAST(len(list_distinct(regexp_extract_all({rest}, '(?s).', 0))) AS INTEGER)"


def first_integer(text: str) -> str:
    return f"TRY_CAST(regexp_extract({text}, '-?[0-9]+', 0) AS BIGINT)"


def url_post_id(url: str) -> str:
    return f"string_split({url}, '/')[-3]"


def url_community(url: str) -> str:
    return f"string_split({url}, '/')[5]"
