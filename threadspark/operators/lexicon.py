"""Token-level operators: long token tables, a vocabulary-checked lemma lexicon, lemmatisation.

Lemmas follow the noun detachment rules of WordNet's morphological processor:
a word's candidates are its rule rewrites; only candidates present in a
*known-word table* survive, the shortest wins (ties: rule order), and a word
without a surviving candidate is its own lemma. The known-word table is a
DataFrame -- by default the corpus' own vocabulary -- so the lexicon is derived
by Spark from the data and joined, never shipped through the driver.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadspark.functions.text import splice, tokenize
from threadspark.session import materialize

# Noun suffix rules (suffix, replacement), in rule order.
NOUN_RULES = [
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
]


def lemma_lexicon(known: DataFrame, word_col: str = "token") -> DataFrame:
    """``(form, lemma)`` for every known word whose lemma differs from itself."""
    words = known.select(F.col(word_col).alias("form")).distinct()
    cands = []
    for i, (suffix, repl) in enumerate(NOUN_RULES, start=1):
        stem = F.expr(f"substring(form, 1, length(form) - {len(suffix)})")
        cands.append(
            F.when(
                F.col("form").endswith(suffix),
                F.struct(F.lit(i).alias("i"), F.concat(stem, F.lit(repl)).alias("c")),
            )
        )
    exploded = words.select("form", F.explode(F.filter(F.array(*cands), lambda s: s.isNotNull())).alias("k"))
    exploded = exploded.select("form", F.col("k.i").alias("i"), F.col("k.c").alias("cand"))
    known_cands = exploded.join(words.select(F.col("form").alias("cand")), "cand", "left_semi")
    best = known_cands.groupBy("form").agg(F.min_by("cand", F.struct(F.length("cand"), F.col("i"))).alias("lemma"))
    return best.where(F.col("lemma") != F.col("form"))


def lemmatize_rows(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Replace each token by its lemma (left join; unknown tokens stay)."""
    lex = lexicon.select(F.col("form").alias("_form"), F.col("lemma").alias("_lemma"))
    out = tokens.join(lex, tokens["token"] == lex["_form"], "left")
    return out.withColumn("lemma", F.coalesce(F.col("_lemma"), F.col("token"))).drop("_form", "_lemma")


def lemmatize_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Lower-case, tokenise, lemmatise and join with spaces -> ``(id, lemma_text)``.

    Documents without tokens get an empty string.
    """
    # tokenise once: the token arrays feed both the lexicon and the lookup
    arrays = materialize(docs.select(F.col(id_col), tokenize(F.lower(F.col(text_col))).alias("_toks")))
    lex = lemma_lexicon(known if known is not None else arrays.select(F.explode(F.array_distinct("_toks")).alias("token")))
    # Only tokens with a rule's suffix can change: the others never leave their document.
    toks = arrays.select(F.col(id_col), F.posexplode("_toks").alias("pos", "token"))
    able = reduce(or_, (F.col("token").endswith(suffix) for suffix, _ in NOUN_RULES))
    changed = lemmatize_rows(toks.where(able), lex).where(F.col("lemma") != F.col("token"))
    edit = F.struct("pos", F.lit(1).alias("width"), F.col("lemma").alias("value"))
    edits = changed.groupBy(F.col(id_col).alias("_eid")).agg(F.array_sort(F.collect_list(edit)).alias("_edits"))
    joined = arrays.join(edits, F.col(id_col) == F.col("_eid"), "left")
    text = F.array_join(splice(F.col("_toks"), F.col("_edits")), " ")
    return joined.select(id_col, F.coalesce(text, F.lit("")).alias("lemma_text"))
