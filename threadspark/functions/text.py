"""Scalar text functions as native Column expressions."""

from __future__ import annotations

import codecs
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from threadspark.functions.html import WS

WS_CHARS = WS[1:-1]  # the white-space class without its brackets
WORD = r"[\p{L}\p{N}_]"

# Tokenisation rules (Treebank style, documented here rather than bit-compatible):
# 1. split "n't" off its word and split the clitics 's 'm 'd 'll 're 've;
# 2. tokens are words (letters/digits/underscore, joined by inner - . , '),
#    "n't", clitics, "..." and any other single non-space character.
CONTRACTION_RE = r"(?i)(\p{L})(n't)\b"
CLITIC_RE = r"(?i)(\p{L})('(?:s|m|d|ll|re|ve))\b"
TOKEN_RE = (
    r"(?i)n't|'(?:s|m|d|ll|re|ve)\b|" + WORD + r"+(?:[-.,']" + WORD + r"+)*|\.\.\.|[^\p{L}\p{N}_" + WS_CHARS + "]"
)


def tokenize(text: Column) -> Column:
    """ARRAY<STRING> of word tokens (case preserved)."""
    t = F.regexp_replace(text, CONTRACTION_RE, "$1 $2")
    t = F.regexp_replace(t, CLITIC_RE, "$1 $2")
    t = F.when(text.contains("'"), t).otherwise(text)  # both patterns hold an apostrophe
    return F.regexp_extract_all(t, F.lit(TOKEN_RE), 0)


def splice(tokens: Column, edits: Column) -> Column:
    """``tokens`` with every edit ``(pos, width, value)`` replacing ``width`` items from ``pos`` (from 0) by ``value``.

    ``edits`` is sorted by position and its edits do not overlap; null edits change nothing. The edits are laid
    out along the token positions and both arrays zipped, so the work is linear in the tokens.
    """
    kept = F.lit(None).cast("struct<value:string>")
    swallowed = F.struct(F.lit(None).cast("string").alias("value"))

    def end_before(i: Column) -> Column:
        last = F.get(edits, i - 1)
        return F.when(i == 0, 0).otherwise(last["pos"] + last["width"])

    layout = F.transform(
        edits,
        lambda e, i: F.concat(
            F.array_repeat(kept, e["pos"] - end_before(i)),
            F.array(F.struct(e["value"].alias("value"))),
            F.array_repeat(swallowed, e["width"] - 1),
        ),
    )
    merged = F.zip_with(tokens, F.flatten(layout), lambda t, e: F.when(e.isNull(), t).otherwise(e["value"]))
    return F.when(edits.isNull(), tokens).otherwise(F.filter(merged, lambda t: t.isNotNull()))


def ascii_replace(text: Column) -> Column:
    """X7 (ASCII): every non-ASCII code point becomes '?'."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


#: Texts of an Arrow batch that are Python strings at a time.
SLICE_ROWS = 64


def encode_replace(text: Column, encoding: str, decoding: str | None = None) -> Column:
    """The text encoded with '?' for what ``encoding`` cannot hold, then decoded again.

    ``decoding`` defaults to the same codec; with another one a text whose bytes it cannot
    read is null. Any Python codec; one Arrow batch at a time. ``ascii`` has its own expression, :func:`ascii_replace`.
    """
    out = codecs.lookup(decoding or encoding).name  # an unknown codec fails here, not in a task
    codecs.lookup(encoding)

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else t.encode(encoding, "replace").decode(out)
        except UnicodeDecodeError:
            return None

    def run(batch: pa.Array) -> pa.Array:
        # a slice at a time: as Python strings a text may take four times its bytes, twice
        parts = [pa.array([one(t) for t in batch.slice(a, SLICE_ROWS).to_pylist()], pa.string()) for a in range(0, len(batch), SLICE_ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.arrow_udf(run, "string")(text)


#: Looked for one by one; only other characters are split apart.
_COMMON = " \n\t.,;:!?'\"()<>/-=&#_"


def nonalnum_distinct(text: Column) -> Column:
    """Number of distinct characters that are neither letters nor digits."""
    rest = F.regexp_replace(F.regexp_replace(text, "[A-Za-z0-9]++", ""), r"[\p{L}\p{N}]++", "")

    def count(r: Column) -> Column:
        rare = F.size(F.array_distinct(F.regexp_extract_all(F.translate(r, _COMMON, ""), F.lit("(?s)."), 0)))
        return reduce(lambda n, c: n + F.contains(r, F.lit(c)).cast("int"), _COMMON, rare)

    return F.element_at(F.transform(F.array(rest), count), 1)  # a lambda variable is computed once


def char_length(text: Column) -> Column:
    """Length in code points."""
    return F.length(text)


def first_integer(text: Column) -> Column:
    """P5: first (optionally negative) integer in the text, else null."""
    return F.regexp_extract(text, r"-?[0-9]+", 0).try_cast("bigint")


def strip_fullname(col: Column, prefix: str = "t1_") -> Column:
    """Remove every occurrence of the fullname prefix."""
    return F.replace(col, F.lit(prefix), F.lit(""))


def url_post_id(url: Column) -> Column:
    """Third-last path piece of the URL (null when absent)."""
    return F.try_element_at(F.split(url, "/"), F.lit(-3))


def url_community(url: Column) -> Column:
    """Fifth path piece of the URL (index 4), null when absent."""
    return F.try_element_at(F.split(url, "/"), F.lit(5))
