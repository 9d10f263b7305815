"""Vocabulary and bag-of-words (M3-M4).

The vocabulary keeps terms with ``no_below <= df <= floor(no_above * N)`` (df =
number of documents containing the term, N = number of documents), then, when
``keep_n`` is given, that many most frequent by df (ties by term). Term ids are
assigned by that order, so they are deterministic. All tokens of a document count
unless ``max_tokens`` is given. A vocabulary of at most LOOKUP_TERMS terms (counted) is sent to the
documents, as a broadcast or as the list of :func:`vectorizer`, the MLlib model form; with a larger one
vectors are put together from (term id, count) rows.
"""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from threadspark.session import materialize

# Library defaults a caller may pass (vocabulary cap, BoW token prefix).
KEEP_N = 100_000
MAX_TOKENS = 5000
#: Terms up to which a vocabulary goes to the documents; beyond that the tokens are shuffled to the vocabulary.
LOOKUP_TERMS = 200_000


def doc_freq(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``(term, df)``: number of documents containing each term (partial aggregation)."""
    return docs.select(F.explode(F.array_distinct(F.col(tokens_col))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df")
    )


def build_vocabulary(
    docs: DataFrame, tokens_col: str = "tokens", no_below: int = 5, no_above: float = 0.2, keep_n: int | None = None
) -> DataFrame:
    """M3: ``(term, term_id, df)`` after the extremes filter and, if asked for, the top-``keep_n`` cut.

    Terms are numbered by range partition plus offsets, so no task holds them all.
    """
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    dfs = doc_freq(docs, tokens_col)
    kept = dfs.where((F.col("df") >= no_below) & (F.col("df") <= F.floor(F.lit(no_above) * n_docs)))
    if keep_n is not None:
        kept = kept.orderBy(F.desc("df"), F.asc("term")).limit(keep_n)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("df"), F.asc("term")]
    # range bounds come from a sample: held, the terms are not counted a second time for it; the second checkpoint keeps partition ids fixed
    parts = materialize(materialize(kept).repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    totals = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_t"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    numbered = parts.withColumn("_local", local).join(F.broadcast(offsets), "_pid")  # one row per partition id
    return numbered.select("term", (F.col("_off") + F.col("_local")).cast("int").alias("term_id"), "df")


def _tokens(tokens_col: str, max_tokens: int | None):
    return F.col(tokens_col) if max_tokens is None else F.slice(F.col(tokens_col), 1, max_tokens)


def bag_of_words(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens",
                 max_tokens: int | None = None) -> DataFrame:
    """M4 (relational): ``(id, term_id, cnt)`` over all tokens (or the first ``max_tokens``); unknown terms dropped."""
    toks = docs.select(F.col(id_col), F.explode(_tokens(tokens_col, max_tokens)).alias("term"))
    known = vocab.select("term", "term_id")
    known = F.broadcast(known) if known.limit(LOOKUP_TERMS + 1).count() <= LOOKUP_TERMS else known
    return toks.join(known, "term").groupBy(id_col, "term_id").agg(
        F.count(F.lit(1)).alias("cnt")
    )


def vectorizer(vocab: DataFrame, tokens_col: str = "bow_tokens", out_col: str = "features") -> CountVectorizerModel:
    """M4 (vector): a CountVectorizerModel whose index i is term_id i.

    The model holds the vocabulary as a list: build it with ``keep_n``.
    """
    terms = [r.term for r in vocab.orderBy("term_id").select("term").collect()]
    return CountVectorizerModel.from_vocabulary(terms, inputCol=tokens_col, outputCol=out_col)


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether rows share an id (null counts as one); reads the ids only."""
    return not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def bow_vectors(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens",
                max_tokens: int | None = None) -> DataFrame:
    """M4 (vector): ``(id, features SparseVector)`` over all tokens (or the first ``max_tokens``), one row per id.

    A vocabulary of at most LOOKUP_TERMS terms goes to the documents (:func:`vectorizer`), whose tokens are counted where they
    are read. With a larger one, or where rows share an id, each document's (term_id, count) rows become its sparse vector; the
    vocabulary is a join and one number (its size), never a list. A document without a known term has the zero vector.
    """
    n_terms, n_ids, n_rows, size = vocab.agg(
        F.count_distinct("term"), F.count_distinct("term_id"), F.count(F.lit(1)), F.coalesce(F.max("term_id") + 1, F.lit(0)).cast("int")
    ).first()
    if 0 < n_rows <= LOOKUP_TERMS and n_terms == n_ids == n_rows == size and not _repeats(docs, id_col):
        counted = docs.select(id_col, F.coalesce(_tokens(tokens_col, max_tokens), F.array().cast("array<string>")).alias("_bow"))
        return vectorizer(vocab, "_bow").transform(counted).select(id_col, "features")
    pairs = F.array_sort(F.collect_list(F.struct("term_id", F.col("cnt").cast("double").alias("cnt"))))
    held = bag_of_words(docs, vocab, id_col, tokens_col, max_tokens).groupBy(F.col(id_col).alias("_id")).agg(pairs.alias("_p"))
    empty = F.array().cast("array<struct<term_id: int, cnt: double>>")
    # the stored form of a sparse vector (type 0), read through the vector type's own JSON reader
    stored = F.struct(
        F.lit(0).alias("type"), F.lit(size).alias("size"), F.transform("_q", lambda x: x["term_id"]).alias("indices"), F.transform("_q", lambda x: x["cnt"]).alias("values")
    )
    rows = docs.select(id_col).distinct().join(held, F.col(id_col).eqNullSafe(F.col("_id")), "left").withColumn("_q", F.coalesce("_p", empty))
    schema = StructType([StructField("v", VectorUDT())])
    return rows.select(id_col, F.from_json(F.to_json(F.struct(stored.alias("v"))), schema)["v"].alias("features"))
