"""Phrase learning and application over tokenised documents (M1-M2).

Input: a DataFrame with a document id and an ``ARRAY<STRING>`` of tokens.

Learning counts unigrams and adjacent bigrams in one pass (each token array is
zipped with itself shifted by one, so no window or Python is needed),
scores every bigram and keeps those scoring above the threshold:

* ``default``: ``(n_ab - min_count) / (n_a * n_b) * V`` with ``V`` the number of
  distinct vocabulary keys (unigrams and joined bigrams);
* ``npmi``: ``ln(p_ab / (p_a p_b)) / -ln(p_ab)`` with ``p = n / total tokens``,
  only for ``n_ab >= min_count``.

Application is greedy, left to right and non-overlapping: inside every run of
consecutive positions whose bigram is a phrase, the 1st, 3rd, 5th... positions
start a phrase and swallow the next token (gaps-and-islands over flagged
positions only).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadspark.functions.text import splice
from threadspark.session import materialize, stored

DELIMITER = "_"
#: Phrases, or words holding the delimiter, up to which they are broadcast; beyond that the pairs are shuffled to them.
LOOKUP_ROWS = 500_000


def _lookup(rows: DataFrame) -> DataFrame:
    """``rows``, marked for broadcast while there are few of them."""
    return F.broadcast(rows) if rows.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS else rows


def _successor_pairs(docs: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """``(id, pos, a, b)`` for every token ``a`` with its successor ``b`` (null after the last token)."""
    # the successor is looked up in the document's own array, so no array of pairs is built
    held = docs.select(F.col(id_col), F.col(tokens_col).alias("_toks"))
    return held.select(id_col, "_toks", F.posexplode("_toks").alias("pos", "a")).select(
        id_col, "pos", "a", F.get("_toks", F.col("pos") + 1).alias("b")
    )


def bigram_rows(docs: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """``(id, pos, a, b)`` for every adjacent token pair (pos = position of ``a``)."""
    return _successor_pairs(docs, id_col, tokens_col).where(F.col("b").isNotNull())


def _check_params(scoring: str, threshold: float) -> None:
    if scoring == "default" and threshold <= 0:
        raise ValueError("threshold should be positive for default scoring")
    if scoring == "npmi" and not (-1 <= threshold <= 1):
        raise ValueError("threshold should be between -1 and 1 for npmi scoring")
    if scoring not in ("default", "npmi"):
        raise ValueError(f"unknown scoring {scoring!r}")


def _vocabulary_size(uni: DataFrame, bi: DataFrame) -> Column:
    """Number of distinct keys, unigrams and joined bigrams, as a scalar subquery.

    Two keys are one only where a word holds the delimiter: a bigram of two words without it has one place to
    be cut, so it equals no other bigram, and of the unigrams only the one cut there. So the words holding it and the
    bigrams of such words are told apart as strings; all others are counted, less those that are a unigram as well.
    """
    word, a, b = F.col("w"), F.col("a"), F.col("b")
    joined = F.concat(a, F.lit(DELIMITER), b)
    plain = ~(a.contains(DELIMITER) | b.contains(DELIMITER))
    marked = uni.where(word.contains(DELIMITER)).select(word.alias("k")).unionByName(bi.where(~plain).select(joined.alias("k")))
    cut = F.split(word, DELIMITER, -1)
    cuts = uni.where(F.size(cut) == 2).select(cut[0].alias("a"), cut[1].alias("b"))
    counts = [
        uni.where(~word.contains(DELIMITER)).select(F.count(F.lit(1)).alias("n")),
        bi.where(plain).select(F.count(F.lit(1)).alias("n")),
        marked.select(F.count_distinct("k").alias("n")),
        bi.where(plain).join(_lookup(cuts), ["a", "b"], "left_semi").select((-F.count(F.lit(1))).alias("n")),
    ]
    return reduce(DataFrame.unionByName, counts).select(F.sum("n")).scalar()


def learn_phrases(
    docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens",
    min_count: int = 1, threshold: float = 10.0, scoring: str = "default",
) -> DataFrame:
    """M1: ``(a, b, phrase, n_ab, n_a, n_b, score)`` for every bigram with score > threshold."""
    _check_params(scoring, threshold)
    # one pass over the tokens: (token, successor) counts; successor null = last token of a document
    counts = stored(
        _successor_pairs(docs, id_col, tokens_col).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    )
    uni = materialize(counts.groupBy(F.col("a").alias("w")).agg(F.sum("n").alias("n")))
    bi = counts.where(F.col("b").isNotNull()).select("a", "b", F.col("n").alias("n_ab"))
    vocab_size = _vocabulary_size(uni, bi)
    total = uni.select(F.sum("n")).scalar()
    # a bigram met too seldom scores no more than 0 (default) or nothing (npmi), so only the others meet their words
    bi = bi.where(F.col("n_ab") > min_count if scoring == "default" else F.col("n_ab") >= min_count)
    na = uni.select(F.col("w").alias("a"), F.col("n").alias("n_a"))
    nb = uni.select(F.col("w").alias("b"), F.col("n").alias("n_b"))
    s = bi.join(na, "a").join(nb, "b")
    n_ab, n_a, n_b = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b"))
    if scoring == "default":
        score = (F.col("n_ab") - F.lit(min_count)).cast("double") / (F.col("n_a") * F.col("n_b")).cast("double") * vocab_size
    else:
        tot = total.cast("double")
        p_ab, p_a, p_b = n_ab / tot, n_a / tot, n_b / tot
        score = F.when(F.col("n_ab") >= min_count, F.log(p_ab / (p_a * p_b)) / -F.log(p_ab))
    s = s.withColumn("score", score)
    return s.where(F.col("score") > threshold).select(
        "a", "b", F.concat(F.col("a"), F.lit(DELIMITER), F.col("b")).alias("phrase"), "n_ab", "n_a", "n_b", "score"
    )


def apply_phrases(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", tokens_col: str | Column = "tokens",
                  out_col: str = "phrased") -> DataFrame:
    """M2: greedy left-to-right phrase merge -> ``(id, out_col ARRAY<STRING>)``.

    Documents keep their row even when empty. ``tokens_col`` may be an expression over ``docs``, such as the tokens of a
    text: it is computed where it is needed, so that texts are moved to their edits, not tokens, and phrases are looked up where
    the texts are read.
    """
    tokens = F.col(tokens_col) if isinstance(tokens_col, str) else tokens_col
    pairs = bigram_rows(docs.select(id_col, tokens.alias("_held")), id_col, "_held")
    known = _lookup(materialize(phrases.select("a", "b").distinct()))
    value = F.concat(F.col("a"), F.lit(DELIMITER), F.col("b")).alias("value")
    flagged = pairs.join(known, ["a", "b"], "left_semi").select(id_col, "pos", value)
    w = Window.partitionBy(id_col, "_grp")
    runs = flagged.withColumn("_grp", F.col("pos") - F.row_number().over(Window.partitionBy(id_col).orderBy("pos")))
    runs = runs.withColumn("_off", F.col("pos") - F.min("pos").over(w))
    starts = runs.where(F.col("_off") % 2 == 0)
    # the starts of a document meet its tokens once, in one row
    edit = F.struct("pos", F.lit(2).alias("width"), "value")
    edits = starts.groupBy(F.col(id_col).alias("_eid")).agg(F.array_sort(F.collect_list(edit)).alias("_edits"))
    joined = docs.join(edits, F.col(id_col) == F.col("_eid"), "left")
    merged = splice(tokens, F.col("_edits"))
    return joined.select(id_col, F.coalesce(merged, F.array().cast("array<string>")).alias(out_col))
