"""Corpus builders over the content table.

Each returns a DataFrame with a ``doc`` column (plus an identifying column where
the document comes from one unit or one chain). Length bounds follow the
reference exactly: strict for paragraphs, inclusive for the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadspark.functions.html import html_to_paragraphs, html_to_source
from threadspark.operators.threads import reach, with_leaf
from threadspark.session import stored

# Separators used when rendering corpus documents.
TITLE_SEP = " \n "
CHAIN_HEAD = " says:"
CHAIN_SEP = "\n "


def paragraph_corpus(units: DataFrame, min_len: int = 50, max_len: int = 1000) -> DataFrame:
    """Distinct paragraphs of all units plus non-null titles, ``min < len < max``, sorted."""
    paras = units.select(F.explode(html_to_paragraphs(F.col("text"))).alias("doc"))
    titles = units.where(F.col("title").isNotNull()).select(F.col("title").alias("doc"))
    docs = paras.unionByName(titles).distinct()
    n = F.length("doc")
    return docs.where((n > min_len) & (n < max_len)).orderBy("doc")


def html_corpus(units: DataFrame, min_len: int = 50, max_len: int = 1000) -> DataFrame:
    """Raw HTML bodies with ``min <= len <= max``; duplicates kept."""
    n = F.length("text")
    return units.where((n >= min_len) & (n <= max_len)).select("id", F.col("text").alias("doc"))


def source_corpus(units: DataFrame, min_len: int = 50, max_len: int = 1000) -> DataFrame:
    """Posts -> ``title + ' \\n ' + source``, others -> source; inclusive bounds; distinct, sorted."""
    rendered = units.select("title", html_to_source(F.col("text")).alias("_src"))  # once per unit
    src = F.col("_src")
    doc = F.when(F.col("title").isNotNull(), F.concat(F.col("title"), F.lit(TITLE_SEP), src)).otherwise(src)
    docs = rendered.select(doc.alias("doc")).distinct()
    n = F.length("doc")
    return docs.where((n >= min_len) & (n <= max_len)).orderBy("doc")


def chain_corpus(units: DataFrame, min_len: int = 50, max_len: int = 1000, null_text: str = "None") -> DataFrame:
    """C4: one document per chain: ``{root user} says:`` then, per unit in rank order,
    ``\\n {title}`` when present and ``\\n {source}``; inclusive bounds; duplicates kept.

    The source text is rendered once per unit and a chain's body grows from its post down
    (:func:`threads.reach`), so no unit's text is looked up once per chain through it.
    """
    # a post meets its user before the chains grow, so no chain is shuffled for the head of its document
    users = units.where("is_post").select(F.col("id").alias("_root"), F.coalesce(F.col("user"), F.lit(null_text)).alias("_user"))
    held = units.where("is_post").join(users, F.col("id") == F.col("_root")).drop("_root")
    held = held.unionByName(units.where(~F.coalesce("is_post", F.lit(False))).withColumn("_user", F.lit(None).cast("string")))
    # leaves are known by their ids before the chains grow, so no chain is shuffled to find out that it is whole
    rendered = with_leaf(held, units).select("id", "parent_id", "is_post", "title", "_user", "_leaf", html_to_source(F.col("text")).alias("_src"))
    head = F.when(F.col("is_post"), F.concat("_user", F.lit(CHAIN_HEAD))).otherwise(F.lit(""))
    titled = F.when(F.col("title").isNotNull(), F.concat(F.lit(CHAIN_SEP), F.col("title"))).otherwise(F.lit(""))
    tips = reach(rendered, F.concat(head, titled, F.lit(CHAIN_SEP), F.col("_src")), leaf="_leaf").tips
    chains = tips.where(F.col("id").isNotNull()).select(F.col("id").alias("chain_id"), F.col("value").alias("doc"))
    n = F.length("doc")
    return stored(chains.where((n >= min_len) & (n <= max_len)))  # whole, so a caller's further passes move no text


BUILDERS = {
    "post": source_corpus,
    "post_html": html_corpus,
    "paragraph": paragraph_corpus,
    "chain": chain_corpus,
}


def build_corpus(units: DataFrame, dataset: str, min_len: int = 50, max_len: int = 1000) -> DataFrame:
    """Corpus by name (post, post_html, paragraph, chain); other names raise ValueError."""
    try:
        builder = BUILDERS[dataset]
    except KeyError:
        raise ValueError(f"unknown dataset {dataset!r}; expected one of {sorted(BUILDERS)}") from None
    return builder(units, min_len=min_len, max_len=max_len).select("doc")
