"""Quality rules as weak supervision: rules vote or abstain, EM weighs the votes.

Every rule looks at one document and votes good (1), bad (-1) or abstains (0).
Votes are counted per combination over *all* documents (at most 3^rules rows,
whatever the corpus size) and expectation-maximisation on those counts
estimates how each rule votes on good and on bad documents. The
posterior probability of "good" then replaces the usual all-must-pass filter.

Only built-in column functions are used: no Python runs on the executors.

Edge cases: a null or empty text has no words (all counts 0); repeated rows are
scored independently; a null document id is passed through; extra columns of the
input are ignored by ``document_metrics`` and kept by ``keep_good``. An empty
table gives an empty result (EM then keeps its starting shares).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.llm.common import as_rows, let, words
from threadspark.session import materialize

WINDOW = 8
SYMBOLS_RE = r"[#*$%&|<>]"

#: Function words of the corpus languages (fixed values: small closed-class lists).
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "with", "on", "for"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "que", "pour"],
    "de": ["der", "die", "das", "und", "ist", "mit", "ein", "eine", "den", "von"],
    "es": ["el", "los", "del", "una", "que", "por", "con", "para", "las", "se"],
}

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop", "n_upper", "n_lines"]


def _window_hashes(hashes: Column, n: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(hashes) - n),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]),
    )


def _covered(windows: Column, n: int) -> Column:
    """Words inside windows whose hash occurs at least twice: sort, keep equal neighbours, add up the union."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    twice = let(
        pairs,
        lambda s: F.filter(
            s,
            lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)),
        ),
    )
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        starts,
        zero,
        lambda a, p: F.struct((a["n"] + p + n - F.greatest(p, a["end"])).alias("n"), (p + n).alias("end")),
        lambda a: a["n"],
    )


def repeated_words(hashes: Column, n: int = WINDOW) -> Column:
    """Words of a document lying in an n-word window that occurs twice or more in it (64-bit window hashes)."""
    body = let(
        _window_hashes(hashes, n),
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w, n)),
    )
    return F.when(F.size(hashes) > n, body).otherwise(F.lit(0).cast("long"))


def document_metrics(text: Column) -> Column:
    """Struct of whole-text counts used by the rules; see ``METRICS``."""
    t = F.coalesce(text, F.lit(""))
    stop = F.array(*[F.lit(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws})])
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long0 = F.lit(0).cast("long")
    return let(
        F.struct(words(text).alias("w"), lines.alias("l")),
        lambda d: F.struct(
            F.size(d["w"]).cast("long").alias("n_words"),
            F.aggregate(d["w"], long0, lambda a, w: a + F.length(w)).alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS_RE)).cast("long").alias("n_symbols"),
            (F.size(d["l"]) - F.size(F.array_distinct(d["l"]))).cast("long").alias("n_dup_lines"),
            let(F.transform(d["w"], lambda w: F.xxhash64(w)), lambda h: repeated_words(h)).alias("n_repeat_words"),
            F.size(F.array_intersect(stop, d["w"])).cast("long").alias("n_stop"),
            F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
            F.size(d["l"]).cast("long").alias("n_lines"),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_votes() -> dict[str, Column]:
    """Rule name -> vote column (1 good, -1 bad, 0 abstains) over the ``METRICS`` columns."""

    n, chars = F.col("n_words"), F.col("word_chars")
    bad = lambda c: F.when(c, -1).otherwise(0)  # noqa: E731  a detector that stays silent says nothing for "good"
    both = lambda good, c: F.when(c, -1).when(good, 1).otherwise(0)
    return {
        "length": both(n >= 50, n < 20),
        "word_length": both((chars >= 3 * n) & (chars <= 8 * n), (chars < 2 * n) | (chars > 12 * n)),
        "stop_words": both(F.col("n_stop") >= 2, (F.col("n_stop") == 0) & (n >= 50)),
        "symbols": bad(100 * F.col("n_symbols") > 25 * n),
        "symbol_chars": bad(100 * F.col("n_symbols") > 4 * chars),
        "dup_lines": bad(100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        "repeats": bad(100 * F.col("n_repeat_words") > 25 * n),
        "upper_case": bad(100 * F.col("n_upper") > 40 * chars),
    }


#: Starting shares of the votes -1, 0, 1 on good and on bad documents; they fix what "good" means.
START_GOOD, START_BAD, START_PRIOR = (0.01, 0.39, 0.60), (0.30, 0.50, 0.20), 0.8


def weights(model: dict) -> list[tuple[float, float, float]]:
    """Log-likelihood ratio good : bad of the votes -1, 0, 1 of each rule; a rule never counts against its own vote."""
    out = []
    for g, b in zip(model["good"], model["bad"]):
        w = [math.log(x / y) for x, y in zip(g, b)]
        out.append((min(0.0, w[0]), w[1], max(0.0, w[2])))
    return out


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, iterations: int = 25) -> dict:
    """EM on counted vote patterns (bounded by 3^rules rows).

    ``good[r]`` / ``bad[r]``: shares of rule r's votes (-1, 0, 1) on good / bad documents. One
    pseudo-count, spread like the starting shares, keeps every share positive.
    """
    model = {"prior": START_PRIOR, "good": [START_GOOD] * n_rules, "bad": [START_BAD] * n_rules}
    total = sum(c for _, c in patterns)
    for _ in range(iterations if total else 0):
        w, base = weights(model), math.log(model["prior"] / (1 - model["prior"]))
        good, bad = [list(START_GOOD) for _ in range(n_rules)], [list(START_BAD) for _ in range(n_rules)]
        sure = 0.0
        for votes, count in patterns:
            z = base + sum(w[r][v + 1] for r, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))
            sure += p * count
            for r, v in enumerate(votes):
                good[r][v + 1] += p * count
                bad[r][v + 1] += (1 - p) * count
        share = lambda x: tuple(c / sum(x) for c in x)
        model = {"prior": (sure + 1) / (total + 2), "good": [share(x) for x in good], "bad": [share(x) for x in bad]}
    return model


def log_odds(model: dict) -> Column:
    """Posterior log-odds of "good" as a sum of literals chosen by the votes."""
    z = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for (down, silent, up), vote in zip(weights(model), rule_votes().values()):
        z = z + F.when(vote == 1, F.lit(up)).when(vote == -1, F.lit(down)).otherwise(F.lit(silent))
    return z


def fit_on(metrics: DataFrame) -> dict:
    """Count the vote patterns of all documents and fit the label model on them."""
    votes = rule_votes()
    rows = metrics.select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).count().collect()
    return fit_label_model(sorted((tuple(r[:-1]), r[-1]) for r in rows), len(votes))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``METRICS``, base_failed, quality (posterior), kept.

    The metrics are checkpointed (a few numbers a document), so the texts are read once.
    """
    m = materialize(docs.select(F.col(id_col), document_metrics(F.col(text)).alias("m")).select(id_col, "m.*"))
    z = log_odds(fit_on(m))
    scored = m.withColumn("quality", 1 / (1 + F.exp(-z))).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents (all their columns) that neither fail the base rules nor have a posterior below one half.

    The model is fitted on all documents first; the second scan scores and filters in
    place, so no text is shuffled or joined.
    """
    held = as_rows(docs).select("row", document_metrics(F.col(f"row.{text}")).alias("m"))
    model = fit_on(materialize(held.select("m.*")))
    kept = held.select("row", "m.*").filter(~base_failed() & (log_odds(model) >= 0))
    return kept.select("row.*")
