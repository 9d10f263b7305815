"""Topic-model trials and hyper-parameter search.

A trial turns a content table into a corpus, tokens, phrases, a vocabulary,
a bag of words, two LDA fits and six metrics, and returns one trial record.
The search loop proposes trials (seeds first, then random ones), records
failures as rows with a ``status``, and appends every record to a Parquet log.
The model-guided search fits a gradient-boosted regressor from parameters (and
their pairwise products) to the trial score and ranks random candidates.
"""

from __future__ import annotations

import itertools
import math
import time
import traceback

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadspark.functions.text import tokenize
from threadspark.operators import corpus as C
from threadspark.operators import phrases as PH
from threadspark.operators import topics as TP
from threadspark.operators import vocab as VB
from threadspark.operators.pages import hash_order
from threadspark.operators.threads import reach
from threadspark.schemas import TRIAL_METRICS, TRIAL_PARAM_FIELDS, TRIAL_PARAMS, TRIAL_SCHEMA
from threadspark.session import materialize

# The random search space (inclusive integer ranges, real ranges, choices).
INT_RANGES = {
    "lda_num_topics": (2, 25),
    "chunksize": (100, 2000),
    "passes": (1, 12),
    "iterations": (1, 250),
    "no_below": (4, 100),
    "min_len": (1, 100),
    "max_len": (110, 3000),
    "max_input_jsons": (20, 200),
    "phraser_min_count": (1, 100),
    "phraser_threshold": (-1, 3),
}
REAL_RANGES = {"decay": (0.5, 0.99), "no_above": (0.01, 0.99)}
CHOICES = {
    "alpha": ["symmetric", "asymmetric"],
    "eta": ["symmetric", "auto"],
    "phraser_scorer": ["npmi", "default"],
    "dataset": ["post_html", "post", "paragraph", "chain"],
}
# Trial defaults of a single training call.
TRIAL_DEFAULTS = dict(
    lda_num_topics=50, chunksize=1000, passes=10, iterations=1000, decay=0.8, alpha="asymmetric", eta="auto",
    no_below=5, no_above=0.2, min_len=50, max_len=1000, phraser_min_count=1, phraser_threshold=10,
    phraser_scorer="default", dataset="post", max_input_jsons=40,
)
SEARCH_BUDGET = 10_000


# ------------------------------------------------------------------ H1: random trials


def uniform_draw(key: Column, seed: int, name: str) -> Column:
    """Uniform real in [0, 1) from (seed, name, key): the same on any cluster and partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{name}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def random_trials(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """H1: ``n`` random parameter sets (uniform integers inclusive, uniform reals, uniform choices)."""
    base = spark.range(n).withColumnRenamed("id", "trial")
    cols = []
    for name, dtype in TRIAL_PARAM_FIELDS:
        r = uniform_draw(F.col("trial"), seed, name)
        if name in INT_RANGES:
            lo, hi = INT_RANGES[name]
            c = (F.floor(r * (hi - lo + 1)) + lo).cast("bigint")
        elif name in REAL_RANGES:
            lo, hi = REAL_RANGES[name]
            c = r * (hi - lo) + lo
        else:
            opts = CHOICES[name]
            c = F.element_at(F.array(*[F.lit(o) for o in opts]), (F.floor(r * len(opts)) + 1).cast("int"))
        cols.append(c.cast(dtype).alias(name))
    return base.select("trial", *cols)


# ------------------------------------------------------------------ M14: one trial


def thread_ids(units: DataFrame) -> DataFrame:
    """``units`` + ``thread_id`` (the root post of each reachable unit)."""
    roots = reach(units).nodes.select(F.col("id").alias("_tid_id"), F.col("root").alias("thread_id"))
    return units.join(roots, units["id"] == roots["_tid_id"]).drop("_tid_id")


def sample_threads(units: DataFrame, n: int, seed: int = 0, thread_col: str = "thread_id") -> DataFrame:
    """S4 on threads: the units of ``min(n, #threads)`` threads chosen by seeded hash order."""
    threads = units.select(thread_col).distinct()
    chosen = threads.orderBy(hash_order(F.col(thread_col), seed), thread_col).limit(n)
    return units.join(chosen, thread_col, "left_semi")


def corpus_docs(units: DataFrame, dataset: str, min_len: int, max_len: int) -> DataFrame:
    """C5 with a document key: ``(doc_key, doc)``."""
    if dataset == "post_html":
        d = C.html_corpus(units, min_len, max_len).select(F.col("id").alias("doc_key"), "doc")
    elif dataset == "chain":
        d = C.chain_corpus(units, min_len, max_len).select(F.col("chain_id").alias("doc_key"), "doc")
    elif dataset in ("post", "paragraph"):
        d = C.build_corpus(units, dataset, min_len, max_len).select(F.md5("doc").alias("doc_key"), "doc")
    else:
        raise ValueError(f"unknown dataset {dataset!r}")
    return d


def train_and_measure(tokens: DataFrame, p: dict, seed: int = 0, bow_source: str = "raw", keep_n: int | None = VB.KEEP_N) -> dict:
    """M5-M13 on a tokenised corpus ``(doc_key, tokens)``: returns the six metrics. ``keep_n``: vocabulary cap, None for all terms."""
    t0 = time.perf_counter()
    phrases = PH.learn_phrases(tokens, "doc_key", "tokens", p["phraser_min_count"], p["phraser_threshold"], p["phraser_scorer"])
    phrased = materialize(PH.apply_phrases(tokens, phrases, "doc_key", "tokens", "phrased"))
    vocab = materialize(VB.build_vocabulary(phrased, "phrased", p["no_below"], p["no_above"], keep_n))
    if vocab.isEmpty():
        raise _TrialFailure("empty_vocab", "no term passed the frequency filter")
    source = tokens if bow_source == "raw" else phrased.withColumnRenamed("phrased", "tokens")
    vectors = materialize(TP.spread(VB.bow_vectors(source, vocab, "doc_key", "tokens"), "doc_key"))
    n_docs = vectors.count()
    k = int(p["lda_num_topics"])
    est = dict(k=k, n_docs=n_docs, chunksize=int(p["chunksize"]), passes=int(p["passes"]), decay=float(p["decay"]),
               alpha=p["alpha"], eta=p["eta"], features_col="features", update_every=TP.chunks_per_update(tokens.sparkSession))
    model1 = TP.lda_estimator(seed=seed, **est).fit(vectors)
    training_time = time.perf_counter() - t0
    model2 = TP.lda_estimator(seed=seed + 1, **est).fit(vectors)

    bow = VB.bag_of_words(source, vocab, "doc_key", "tokens")
    top20 = TP.topic_terms(model1, vocab, TP.COHERENCE_TOPN)
    coh = TP.umass_coherence(top20, TP.doc_terms(bow, "doc_key"), n_docs, id_col="doc_key")
    avg_coherence = (coh.agg(F.sum("coherence")).first()[0] or 0.0) / k
    inferred = materialize(TP.doc_bounds(model1, vectors, "doc_key"))  # read twice
    perplexity = -tokens.sparkSession.range(1).select(TP.log_perplexity(model1, inferred)).first()[0]
    top10a = TP.topic_terms(model1, vocab, TP.TOPIC_TOPN)
    top10b = TP.topic_terms(model2, vocab, TP.TOPIC_TOPN)
    diversity = TP.topic_diversity(top10a).first()[0]
    entropy = TP.doc_entropy(model1, vectors, "doc_key", inferred).agg(F.avg("entropy")).first()[0]
    stability = TP.hellinger_min(top10a, top10b).agg(F.sum("min_hellinger")).first()[0] / k
    return {
        "avg_topic_coherence": float(avg_coherence),
        "perplexity": float(perplexity),
        "diversity": float(diversity),
        "avg_entropy": float(entropy),
        "stability_score": float(stability),
        "model_training_time": float(training_time),
    }


class _TrialFailure(Exception):
    def __init__(self, status: str, msg: str):
        super().__init__(msg)
        self.status = status


def run_trial(units: DataFrame, params: dict, seed: int = 0, thread_col: str = "thread_id", bow_source: str = "raw", keep_n: int | None = VB.KEEP_N) -> dict:
    """One trial record (16 parameters, 6 metrics or nulls, ``status``, ``error``).

    ``units`` must carry ``thread_col`` (see :func:`thread_ids`).
    """
    p = {**TRIAL_DEFAULTS, **{k: v for k, v in params.items() if k in TRIAL_PARAMS and v is not None}}
    rec = {k: p[k] for k in TRIAL_PARAMS}
    rec.update({m: None for m in TRIAL_METRICS})
    try:
        if p["phraser_scorer"] == "default" and p["phraser_threshold"] <= 0:
            raise _TrialFailure("invalid_params", "threshold should be positive for default scoring")
        if p["phraser_scorer"] == "npmi" and not (-1 <= p["phraser_threshold"] <= 1):
            raise _TrialFailure("invalid_params", "threshold should be between -1 and 1 for npmi scoring")
        if not (0.5 < float(p["decay"]) <= 1.0):
            raise _TrialFailure("invalid_params", "decay must be in (0.5, 1.0]")
        limit = p["max_input_jsons"]
        sampled = units if limit is None else sample_threads(units, int(limit), seed, thread_col)
        docs = corpus_docs(sampled, p["dataset"], int(p["min_len"]), int(p["max_len"]))
        tokens = materialize(docs.select("doc_key", tokenize(F.col("doc")).alias("tokens")))
        if tokens.isEmpty():
            raise _TrialFailure("empty_corpus", "no document passed the length filter")
        rec.update(train_and_measure(tokens, p, seed, bow_source, keep_n))
        rec["status"], rec["error"] = "ok", None
    except _TrialFailure as e:
        rec["status"], rec["error"] = e.status, str(e)
    except Exception as e:  # a failed trial is recorded, the search goes on
        rec["status"], rec["error"] = "error", f"{type(e).__name__}: {e}"
        traceback.print_exc()
    return rec


def trial_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    rows = []
    for r in records:
        row = []
        for f in TRIAL_SCHEMA.fields:
            v = r.get(f.name)
            if v is not None and isinstance(f.dataType, T.LongType):
                v = int(v)
            elif v is not None and isinstance(f.dataType, T.DoubleType):
                v = float(v)
            row.append(v)
        rows.append(tuple(row))
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


# ------------------------------------------------------------------ H2: search loop


def search_plan(spark: SparkSession, n_trials: int, seeds: DataFrame | None = None, seed_count: int = 0, seed: int = 0) -> DataFrame:
    """``(number, trial_id, parameters...)``: seed trials first, then random ones, ``n_trials`` in all.

    The id is a hash of seed, number and parameters, so the same search plans the same ids wherever it runs.
    """
    columns = [F.col(n).cast(t) for n, t in TRIAL_PARAM_FIELDS]
    seed_rows = []
    if seeds is not None and seed_count:
        seed_rows = seeds.limit(min(seed_count, n_trials)).select(*columns).collect()  # bounded by seed_count
    drawn = random_trials(spark, max(n_trials - len(seed_rows), 0), seed)
    plan = drawn.select((F.col("trial") + len(seed_rows)).alias("number"), *columns)
    if seed_rows:
        first = spark.createDataFrame([(k, *r) for k, r in enumerate(seed_rows)], plan.schema)
        plan = first.unionByName(plan)
    named = F.to_json(F.struct(F.lit(seed).alias("seed"), "number", *TRIAL_PARAMS), {"ignoreNullFields": "false"})
    return plan.select("number", F.md5(named).alias("trial_id"), *TRIAL_PARAMS)


def run_search(units: DataFrame, log_path: str, n_trials: int = SEARCH_BUDGET, seeds: DataFrame | None = None,
               seed_count: int = 0, seed: int = 0, parallel: int = 1, resume: bool = False, batch: int = 20) -> None:
    """H2: seeds first, then random trials; every record is added under ``log_path`` (Parquet).

    The log is append-only: earlier runs' records stay, also when the same seed is used again. With ``resume``
    trials whose id the log holds are left out (an anti-join of :func:`search_plan` with the log), so a stopped
    search goes on where it ended. Records are committed ``batch`` at a time, one file each, and once more
    when the run ends or is stopped: a killed driver loses fewer than ``batch`` finished trials, which run again.

    Each trial is a set of Spark jobs; the loop itself only proposes parameters.
    With ``parallel > 1`` up to that many trials run at once from a bounded thread
    pool, each worker in its own scheduler pool (``spark.scheduler.pool``; fair
    sharing needs ``spark.scheduler.mode=FAIR``); only the calling thread writes the log.
    """
    from concurrent.futures import ThreadPoolExecutor

    from threadspark.sources.readers import read_trials
    from threadspark.sources.writers import append_trials

    spark = units.sparkSession
    units = materialize(thread_ids(units))
    plan = search_plan(spark, n_trials, seeds, seed_count, seed)
    if resume:
        plan = plan.join(read_trials(spark, log_path).select("trial_id"), "trial_id", "left_anti")
    todo = (r.asDict() for r in plan.orderBy("number").toLocalIterator())
    records: list[dict] = []

    def one(params: dict) -> dict:
        if parallel > 1:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trials-{params['number'] % parallel}")
        return {**run_trial(units, params, seed=seed + params["number"]), "trial_id": params["trial_id"]}

    def commit(least: int) -> None:
        if len(records) >= least:
            append_trials(trial_frame(spark, records).coalesce(1), log_path)
            records.clear()

    try:
        if parallel <= 1:
            for params in todo:
                records.append(one(params))
                commit(batch)
            return
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            pending = []
            for params in todo:
                pending.append(pool.submit(one, params))
                if len(pending) >= 2 * parallel:  # keep the queue bounded
                    records.append(pending.pop(0).result())
                    commit(batch)
            for f in pending:
                records.append(f.result())
                commit(batch)
    finally:
        commit(1)


# ------------------------------------------------------------------ H3-H8: model-guided search


def interactions(df: DataFrame, numeric_cols: list[str]) -> DataFrame:
    """H3: ``a_x_b = a * b`` for every pair of numeric columns (n choose 2)."""
    return df.select(
        "*", *[(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in itertools.combinations(numeric_cols, 2)]
    )


def split_columns(df: DataFrame, cols: list[str]) -> tuple[list[str], list[str]]:
    """H4: (numeric, categorical) columns among ``cols`` by their Spark type."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    numeric = [c for c in cols if isinstance(types[c], T.NumericType)]
    categorical = [c for c in cols if isinstance(types[c], T.StringType)]
    return numeric, categorical


def fit_score_model(score_df: DataFrame, score_column: str, parameter_columns: list[str], max_iter: int = 100,
                    step_size: float = 0.1, max_depth: int = 12, seed: int = 0):
    """H5: GBT regression from parameters + interactions to the score. Returns (model, numeric, categorical)."""
    numeric, categorical = split_columns(score_df, parameter_columns)
    fit_df = interactions(score_df, numeric).where(F.col(score_column).isNotNull())
    inter = [f"{a}_x_{b}" for a, b in itertools.combinations(numeric, 2)]
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep") for c in categorical]
    features = numeric + [f"{c}__idx" for c in categorical] + inter
    stages.append(VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"))
    # a split needs a bin per level of the widest categorical column ("keep" adds one for unseen values)
    levels = fit_df.agg(*[F.countDistinct(c) for c in categorical]).first() if categorical else ()
    stages.append(GBTRegressor(featuresCol="features", labelCol=score_column, maxIter=max_iter, stepSize=step_size,
                               maxDepth=max_depth, seed=seed, maxBins=max([64, *(n + 1 for n in levels)])))
    model = Pipeline(stages=stages).fit(fit_df)
    return model, numeric, categorical


def candidates(score_df: DataFrame, parameter_columns: list[str], n: int, set_inputs: dict | None = None,
               seed: int = 0) -> DataFrame:
    """H6: ``n`` candidates: fixed values where given, categorical ~ observed values,
    numeric ~ uniform(min, max) as reals (even for integer parameters)."""
    set_inputs = set_inputs or {}
    numeric, categorical = split_columns(score_df, parameter_columns)
    spark = score_df.sparkSession
    base = spark.range(n)
    drawn = [c for c in parameter_columns if c not in set_inputs and c not in categorical]
    ends = [f(F.col(c).cast("double")) for c in drawn for f in (F.min, F.max)]
    bounds = score_df.agg(*ends).first() if drawn else ()  # one row for all columns
    cols = []
    for c in parameter_columns:
        r = uniform_draw(F.col("id"), seed, c)
        if c in set_inputs:
            cols.append(F.lit(set_inputs[c]).alias(c))
        elif c in categorical:
            # distinct values of one categorical parameter: bounded by its choice list
            vals = sorted(v[0] for v in score_df.select(c).where(F.col(c).isNotNull()).distinct().collect())
            cols.append(F.element_at(F.array(*[F.lit(v) for v in vals]), (F.floor(r * len(vals)) + 1).cast("int")).alias(c))
        else:
            lo, hi = (F.lit(bounds[2 * drawn.index(c) + k]).cast("double") for k in (0, 1))
            cols.append((lo + r * (hi - lo)).alias(c))
    return base.select(*cols)


def score_candidates(model, cands: DataFrame, numeric: list[str], parameter_columns: list[str],
                     ascending: bool = True) -> DataFrame:
    """H7: predicted score for every candidate, sorted (ascending by default)."""
    cast = cands.select(*[F.col(c).cast("double").alias(c) if c in numeric else F.col(c) for c in parameter_columns])
    scored = model.transform(interactions(cast, numeric))
    order = F.col("predicted_score").asc() if ascending else F.col("predicted_score").desc()
    return scored.select(*parameter_columns, F.col("prediction").alias("predicted_score")).orderBy(order)


def predictive_search(score_df: DataFrame, set_inputs: dict, score_column: str = "total_score",
                      parameter_columns: list[str] = TRIAL_PARAMS, iterations: int = 10_000, ascending: bool = True,
                      **gbt) -> DataFrame:
    """H8: ranked trials -> GBT -> ``iterations`` candidates -> sorted predictions."""
    model, numeric, _ = fit_score_model(score_df, score_column, parameter_columns, **gbt)
    cands = candidates(score_df, parameter_columns, iterations, set_inputs)
    return score_candidates(model, cands, numeric, parameter_columns, ascending)


def seed_trials(predicted: DataFrame, n: int, order_col: str = "predicted_score") -> DataFrame:
    """The first ``n`` predicted trials without score columns."""
    return predicted.orderBy(order_col).limit(n).drop("total_score", "predicted_score")
