"""Stored-page operators: listing URLs, link harvesting, link-map upsert, work-lists.

Crawling itself is out of scope; these operators run over pages that were
already saved (``page_id, url, html``) and over link maps (``post_id, url``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.functions.html import ATTRS, HREF_RE, WS, decode_entities, strip
from threadspark.functions.text import url_post_id

# Listing URL templates ({} = community name), in crawl order.
LISTING_TEMPLATES = [
    "https://old.reddit.com/r/{}",
    "https://old.reddit.com/r/{}/top/?sort=top&t=all",
    "https://old.reddit.com/r/{}/controversial/?sort=top&t=all",
]

ANCHOR_RE = r"(?is)<a\b" + ATTRS + r">.*?</a\s*>"


def hash_order(key: Column, seed: int) -> Column:
    """Deterministic pseudo-random order key (identical in any engine with md5)."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), key.cast("string")))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``min(n, N)`` rows without replacement, chosen by a seeded hash order."""
    return df.orderBy(hash_order(F.col(key), seed), F.col(key)).limit(n)


def listing_urls(names: DataFrame, n: int | None = None, seed: int = 0, templates=LISTING_TEMPLATES) -> DataFrame:
    """Every name x template, distinct, in seeded random order, first ``n``."""
    urls = None
    for t in templates:
        pre, post = t.split("{}")
        u = names.select(F.concat(F.lit(pre), F.col("name"), F.lit(post)).alias("url"))
        urls = u if urls is None else urls.unionByName(u)
    urls = urls.distinct()
    return sample_rows(urls, "url", n, seed) if n is not None else urls


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` relative to the page ``base`` URL."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    directory = F.regexp_extract(base, r"^([^?#]*/)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href == "", F.lit(None))
        .otherwise(F.concat(directory, href))
    )


def element_inner(html: Column, element_id: str) -> Column:
    """Markup inside the first element with this id, '' without one; an unclosed element runs to the end.

    What follows the element's open tag is cut before every tag of the same name, and the
    pieces up to the matching end tag (by running depth) are joined.
    """
    eid = r"\Q" + element_id + r"\E"
    open_re = (
        r"""(?is)<([a-z][a-z0-9-]*)(?:[^>"']|"[^"]*"|'[^']*')*?\sid\s*=\s*"""
        + f"""(?:"{eid}"|'{eid}'|{eid}(?=[\\s>]))""" + ATTRS + ">"
    )
    name = F.regexp_extract(html, open_re, 1)
    pieces = F.split(
        F.regexp_extract(html, open_re + r"(.*)\z", 2), F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"(?![a-z0-9-]))")), -1
    )

    def step(acc: Column, piece: Column) -> Column:
        change = F.when(acc["n"] == 0, 0).when(piece.startswith("</"), -1).otherwise(1)
        depth = F.when(acc["depth"] == 0, 0).otherwise(acc["depth"] + change)
        return F.struct(depth.alias("depth"), (acc["n"] + F.when(depth > 0, 1).otherwise(0)).alias("n"))

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    kept = F.aggregate(pieces, start, step, lambda acc: acc["n"])
    return F.when(name == "", "").otherwise(F.array_join(F.slice(pieces, 1, kept), ""))


def anchors(pages: DataFrame, within: str | None = None) -> DataFrame:
    """P2 (first half): every ``<a>`` of every page, or of its element with the id ``within``,
    as ``(page_id, pos, href, text)``.

    ``href`` is resolved against the page URL (null when missing); ``text`` is
    the visible text with tags removed and white space collapsed.
    """
    html = F.col("html") if within is None else element_inner(F.col("html"), within)
    a = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all(html, F.lit(ANCHOR_RE), 0)).alias("pos", "tag"))
    head = F.regexp_extract("tag", r"(?is)^<a\b(" + ATTRS + r")>", 1)
    raw_href = F.concat(*[F.regexp_extract(head, HREF_RE, i) for i in (1, 2, 3)])
    has_href = head.rlike(HREF_RE)
    inner = F.regexp_extract("tag", r"(?is)^<a\b" + ATTRS + r">(.*?)</a\s*>\z", 1)
    text = strip(F.regexp_replace(decode_entities(F.regexp_replace(inner, "<" + ATTRS + ">", "")), WS + "+", " "))
    return a.select(
        "page_id",
        F.col("pos").cast("int").alias("pos"),
        F.when(has_href, resolve_url(F.col("url"), decode_entities(raw_href))).alias("href"),
        text.alias("text"),
    )


def harvest_post_links(
    links: DataFrame, needle: str = "comments", exclude: str = "Can", min_count: int | None = 50
) -> DataFrame:
    """P2 (second half): keep links whose href and text contain ``needle``, whose text
    lacks ``exclude`` and whose first word is an integer >= ``min_count``.

    A non-numeric first word drops that link only. Adds ``post_id`` (P3).
    """
    cond = (
        F.col("href").isNotNull()
        & (F.col("href") != "")
        & F.col("href").contains(needle)
        & F.col("text").contains(needle)
        & ~F.col("text").contains(exclude)
    )
    if min_count is not None:
        first = F.replace(F.regexp_extract("text", r"^\s*(\S+)", 1), F.lit(","), F.lit("")).try_cast("int")
        cond = cond & (first >= min_count)
    return links.where(cond).withColumn("post_id", url_post_id(F.col("href")))


def upsert_links(current: DataFrame, updates: DataFrame, key: str = "post_id") -> DataFrame:
    """Link-map upsert; per key the update wins, and within one side the last row wins.

    Both inputs carry ``(key, url, seq)``; the winner is ``max_by(url, (side, seq))``,
    a partially aggregated group-by, so a hot key costs one row per map task.
    """
    both = current.select(key, "url", "seq", F.lit(0).alias("_side")).unionByName(
        updates.select(key, "url", "seq", F.lit(1).alias("_side"))
    )
    return both.groupBy(key).agg(F.max_by("url", F.struct("_side", "seq")).alias("url"))


def worklist(links: DataFrame, done: DataFrame, saved: DataFrame, cached_only: bool = False, key: str = "post_id") -> DataFrame:
    """Posts still to process.

    Skipped: posts whose thread output exists while their page does not.
    With ``cached_only`` only posts with a saved page are kept.
    """
    skip = done.select(key).join(saved.select(key), key, "left_anti")
    out = links.join(skip, key, "left_anti")
    if cached_only:
        out = out.join(saved.select(key), key, "left_semi")
    return out
