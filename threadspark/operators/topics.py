"""Topic models and their quality metrics.

Training uses MLlib's online variational-Bayes LDA (a distributed optimiser:
each mini-batch is a treeAggregate over executors). Parameters map as:

* ``chunksize`` -> a mini-batch of ``update_every`` chunks: ``subsamplingRate = min(1, update_every * chunksize / N)``.
  The multicore trainer updates its model once per two chunks of every worker (:func:`chunks_per_update`),
  and each update reads all vectors and moves the whole model, so one per chunk would cost N * N / chunksize;
* ``passes``    -> ``maxIter = passes * ceil(N / (update_every * chunksize))`` mini-batches: every document as often, in the mean;
* ``decay``     -> ``learningDecay``; offset 1.0 -> ``learningOffset``;
* ``alpha``     -> ``docConcentration``: symmetric ``1/k`` or asymmetric
  ``1/(i + sqrt(k))`` normalised to sum 1;
* ``eta``       -> ``topicConcentration = 1/k`` (``auto`` learning has no MLlib
  counterpart and is recorded only, as is the inner ``iterations`` budget).

Metrics are DataFrame computations over topic/term tables. Pair tables that
they need (term pairs of a topic's top-n, topic pairs that share a term) are
bounded by the model size (k topics x top-n terms), never by the data.
"""

from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor
from types import FunctionType

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import LDA, LocalLDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# UMass smoothing, minimum topic probability kept per document, top-n sizes.
UMASS_EPSILON = 1e-12
MIN_TOPIC_PROB = 0.01
COHERENCE_TOPN = 20
TOPIC_TOPN = 10


def alpha_vector(alpha: str, k: int) -> list[float]:
    if alpha == "symmetric":
        return [1.0 / k] * k
    if alpha == "asymmetric":
        raw = [1.0 / (i + math.sqrt(k)) for i in range(k)]
        s = sum(raw)
        return [x / s for x in raw]
    raise ValueError(f"unsupported alpha {alpha!r}")


def chunks_per_update(spark: SparkSession) -> int:
    """Chunks the multicore trainer takes in between two updates of the model: two per worker, here per core."""
    return 2 * max(1, spark.sparkContext.defaultParallelism)


def spread(vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``vectors`` over two tasks per core: they are small for their work, and adaptive execution would leave them to a few tasks.

    No more than that, however many vectors there are: a fit reads them as a stream, and every task of every update sends a
    whole model (topics x terms).
    """
    return vectors.repartition(2 * vectors.sparkSession.sparkContext.defaultParallelism, id_col)


def lda_estimator(
    k: int, n_docs: int, chunksize: int = 1000, passes: int = 10, decay: float = 0.8,
    alpha: str = "asymmetric", eta: str = "auto", seed: int = 0, features_col: str = "features", update_every: int = 1,
) -> LDA:
    """M5: an MLlib online LDA configured from the reference's parameters; one update per ``update_every`` chunks."""
    if not (0.5 < decay <= 1.0):
        raise ValueError("decay must be in (0.5, 1.0]")
    if eta not in ("symmetric", "auto"):
        raise ValueError(f"unsupported eta {eta!r}")
    n, batch = max(n_docs, 1), update_every * chunksize
    return LDA(
        k=k,
        optimizer="online",
        maxIter=max(1, passes * math.ceil(n / batch)),
        subsamplingRate=min(1.0, batch / n),
        learningDecay=decay,
        learningOffset=1.0,
        docConcentration=alpha_vector(alpha, k),
        topicConcentration=1.0 / k,
        optimizeDocConcentration=False,
        seed=seed,
        featuresCol=features_col,
    )


def topic_terms(model: LocalLDAModel, vocab: DataFrame, topn: int = TOPIC_TOPN) -> DataFrame:
    """M9: ``(topic, rank, term_id, term, weight)`` for the top-``topn`` terms of every topic."""
    t = model.describeTopics(topn).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "z")
    )
    t = t.select("topic", "rank", F.col("z.termIndices").alias("term_id"), F.col("z.termWeights").alias("weight"))
    return t.join(vocab.select("term_id", "term"), "term_id", "left").select("topic", "rank", "term_id", "term", "weight")


def doc_terms(bow: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Distinct (document, term) occurrences of a relational bag of words."""
    return bow.select(id_col, "term_id").distinct()


def umass_coherence(topics: DataFrame, occurrences: DataFrame, n_docs, id_col: str = "doc_id",
                    topic_col: str = "topic", term_col: str = "term_id", rank_col: str = "rank") -> DataFrame:
    """M7: UMass coherence per topic over document co-occurrence.

    ``topics``: ``(topic, rank, term)`` top terms (rank 0 = most probable);
    ``occurrences``: distinct ``(doc, term)``; ``n_docs``: a number or scalar Column.
    For each pair (later term w_i, earlier term w_j):
    ``ln((D(w_i, w_j)/N + eps) / (D(w_j)/N))``; topic score = mean over pairs.
    """
    t = topics.select(F.col(topic_col).alias("topic"), F.col(rank_col).alias("r"), F.col(term_col).alias("w"))
    ti, tj = t.alias("i"), t.alias("j")
    pairs = ti.join(tj, (F.col("i.topic") == F.col("j.topic")) & (F.col("j.r") < F.col("i.r"))).select(
        F.col("i.topic").alias("topic"), F.col("i.w").alias("wi"), F.col("j.w").alias("wj")
    )  # at most k * topn*(topn-1)/2 rows: bounded by the model
    occ = occurrences.select(F.col(id_col).alias("d"), F.col(term_col).alias("w"))
    dfreq = occ.join(t.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    # the top terms of a topic that a document holds meet in one row (at most top-n of them); pairs form inside it
    held = occ.join(t, "w").groupBy("d", "topic").agg(F.collect_list(F.struct("r", "w")).alias("ws"))
    inside = F.flatten(F.transform("ws", lambda i: F.transform(
        F.filter("ws", lambda j: j["r"] < i["r"]), lambda j: F.struct(i["w"].alias("wi"), j["w"].alias("wj"))
    )))
    co = held.select("topic", F.explode(inside).alias("p")).groupBy(
        "topic", F.col("p.wi").alias("wi"), F.col("p.wj").alias("wj")
    ).agg(F.count(F.lit(1)).alias("co"))
    n = F.lit(n_docs).cast("double") if not hasattr(n_docs, "cast") else n_docs.cast("double")
    scored = (
        pairs.join(co, ["topic", "wi", "wj"], "left")
        .join(dfreq.select(F.col("w").alias("wj"), "df"), "wj", "left")
        .select(
            "topic",
            F.log((F.coalesce(F.col("co"), F.lit(0)).cast("double") / n + F.lit(UMASS_EPSILON)) / (F.col("df").cast("double") / n)).alias("s"),
        )
    )
    return scored.groupBy("topic").agg(F.avg("s").alias("coherence"))


def topic_diversity(topics: DataFrame, term_col: str = "term_id") -> DataFrame:
    """Distinct top terms / all top-term slots (one row)."""
    return topics.agg((F.count_distinct(term_col) / F.count(F.lit(1))).alias("diversity"))


def distribution_entropy(probs) -> F.Column:
    """M11 (per row): ``-sum p ln p`` over probabilities >= 0.01 (no renormalisation)."""
    kept = F.filter(probs, lambda p: p >= MIN_TOPIC_PROB)
    return F.aggregate(kept, F.lit(0.0).cast("double"), lambda s, p: s - p * F.log(p))


def doc_entropy(model: LocalLDAModel, vectors: DataFrame, id_col: str = "doc_id", inferred: DataFrame | None = None) -> DataFrame:
    """Per-document entropy of the inferred topic distribution (``inferred``: :func:`doc_bounds`, if at hand)."""
    dist = inferred or model.transform(vectors).select(id_col, vector_to_array("topicDistribution").alias("p"))
    return dist.select(id_col, distribution_entropy(F.col("p")).alias("entropy"))


def _digamma(x):
    """Digamma of positive numbers: the asymptotic series, after steps up to 8."""
    x = np.array(x, dtype=float)
    less = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        less += np.where(low, 1 / x, 0)
        x += low
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - less


def doc_bounds(model: LocalLDAModel, vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, p, bound, n)``: a document's topic distribution, its part of the variational bound and its tokens.

    The bound is MLlib's: ``E[ln p(words | theta, beta)] + E[ln p(theta) - ln q(theta)]`` under the document's own gamma, which is
    the distribution times (tokens + sum of alpha). MLlib's ``logPerplexity`` raises the whole model (topics x terms) per
    document; here only the document's terms are looked up, in the broadcast ``E[ln beta]``.
    """
    alpha = np.array(model.estimatedDocConcentration().toArray())
    lam = model.topicsMatrix().toArray()  # terms x topics
    log_beta = vectors.sparkSession.sparkContext.broadcast(_digamma(lam) - _digamma(lam.sum(axis=0)))
    digamma, lgamma = FunctionType(_digamma.__code__, {"np": np}), np.vectorize(math.lgamma, otypes=[float])  # sent by value

    def bound(v, p):
        if not len(v.indices):
            return 0.0
        gamma = np.array(p) * (v.values.sum() + alpha.sum())
        log_theta = digamma(gamma) - digamma(gamma.sum())
        z = log_beta.value[v.indices] + log_theta
        top = z.max(axis=1)
        words = v.values @ (top + np.log(np.exp(z - top[:, None]).sum(axis=1)))
        own = ((alpha - gamma) * log_theta).sum() + (lgamma(gamma) - lgamma(alpha)).sum()
        return float(words + own + lgamma(alpha.sum()) - lgamma(gamma.sum()))

    found = model.transform(vectors).select(id_col, "features", vector_to_array("topicDistribution").alias("p"))
    tokens = F.udf(lambda v: float(v.values.sum()), "double", useArrow=False)
    return found.select(id_col, "p", F.udf(bound, "double", useArrow=False)("features", "p").alias("bound"), tokens("features").alias("n"))


def log_perplexity(model: LocalLDAModel, bounds: DataFrame) -> Column:
    """M8: minus the variational bound per token over the documents of ``bounds`` (:func:`doc_bounds`), as a scalar subquery."""
    lam, eta = model.topicsMatrix().toArray(), model.getTopicConcentration()
    lgamma, total = np.vectorize(math.lgamma, otypes=[float]), lam.sum(axis=0)
    topics = ((eta - lam) * (_digamma(lam) - _digamma(total))).sum() + (lgamma(lam) - math.lgamma(eta)).sum()
    topics += (math.lgamma(eta * len(lam)) - lgamma(total)).sum()
    return bounds.select(-(F.coalesce(F.sum("bound"), F.lit(0.0)) + float(topics)) / F.sum("n")).scalar()


def hellinger_min(run1: DataFrame, run2: DataFrame, topic_col: str = "topic", term_col: str = "term_id",
                  weight_col: str = "weight") -> DataFrame:
    """Per topic of run 1, the min Hellinger distance to any topic of run 2.

    Sparse vectors (top terms only): ``H^2 = 0.5 (S_p + S_q - 2 B)`` with ``S`` the
    weight sums and ``B = sum over shared terms of sqrt(p q)``. Topic pairs that
    share a term come from an equi-join on the term. For pairs sharing nothing
    ``B = 0``, so the best of them is the run-2 topic with the smallest ``S_q``
    not among the overlapping ones: found by numbering run-2 topics by ``S_q``
    and taking the first number missing from the overlap set (anti-join), so no
    topic x topic product is formed.
    """
    a = run1.select(F.col(topic_col).alias("t1"), F.col(term_col).alias("w"), F.col(weight_col).alias("p"))
    b = run2.select(F.col(topic_col).alias("t2"), F.col(term_col).alias("w"), F.col(weight_col).alias("q"))
    s1 = a.groupBy("t1").agg(F.sum("p").alias("sp"))
    s2 = b.groupBy("t2").agg(F.sum("q").alias("sq"))
    s2 = s2.withColumn("n2", F.row_number().over(Window.orderBy("sq", "t2")))  # one row per run-2 topic
    shared = a.join(b, "w").groupBy("t1", "t2").agg(F.sum(F.sqrt(F.col("p") * F.col("q"))).alias("bc"))
    shared = shared.join(s2, "t2")
    best_shared = shared.groupBy("t1").agg(F.min(F.col("sq") - 2 * F.col("bc")).alias("m_shared"))
    used = shared.select("t1", "n2")
    cand = used.select("t1", (F.col("n2") + 1).alias("n2")).unionByName(s1.select("t1", F.lit(1).alias("n2")))
    free = cand.join(used, ["t1", "n2"], "left_anti").groupBy("t1").agg(F.min("n2").alias("n2"))
    best_free = free.join(s2.select("n2", F.col("sq").alias("m_free")), "n2")
    out = s1.join(best_shared, "t1", "left").join(best_free.select("t1", "m_free"), "t1", "left")
    m = F.least(F.col("m_shared"), F.col("m_free"))  # least() skips nulls
    dist = F.sqrt(F.greatest(F.lit(0.0), 0.5 * (F.col("sp") + m)))
    return out.select(F.col("t1").alias(topic_col), dist.alias("min_hellinger"))


def fit_lda(vectors: DataFrame, estimator: LDA) -> tuple[LocalLDAModel, float]:
    """Fit and return the model with the wall-clock seconds of the fit."""
    t0 = time.perf_counter()
    model = estimator.fit(vectors)
    return model, time.perf_counter() - t0


def fit_each(vectors: DataFrame, estimators: list[LDA]) -> list[LocalLDAModel]:
    """The models of several estimators over the same vectors, fitted at the same time.

    Between two updates of a model the cores would wait for the driver; another model's update fills that time.
    """
    with ThreadPoolExecutor(len(estimators)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(vectors.sparkSession)(e.fit), vectors) for e in estimators]]
