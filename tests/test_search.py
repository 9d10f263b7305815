"""Search loop, random trials and the model-guided search on small inputs."""

import tempfile

from pyspark.sql import functions as F

from threadspark.operators import search as S
from threadspark.schemas import TRIAL_PARAMS
from threadspark.sources import readers as RD


def test_random_trials_ranges(spark):
    t = S.random_trials(spark, 300, seed=1)
    assert t.count() == 300
    for name, (lo, hi) in S.INT_RANGES.items():
        r = t.agg(F.min(name), F.max(name)).first()
        assert lo <= r[0] and r[1] <= hi
    for name, opts in S.CHOICES.items():
        assert {x[0] for x in t.select(name).distinct().collect()} <= set(opts)


def test_draws_do_not_depend_on_partitioning(spark):
    whole = S.random_trials(spark, 50, seed=2)
    cut = whole.sparkSession.range(50, numPartitions=7).select(S.uniform_draw(F.col("id"), 2, "x").alias("r"))
    one = whole.sparkSession.range(50, numPartitions=1).select(S.uniform_draw(F.col("id"), 2, "x").alias("r"))
    assert sorted(cut.collect()) == sorted(one.collect()) and cut.where("r < 0 OR r >= 1").isEmpty()
    assert 45 <= cut.distinct().count()


def test_search_loop_keeps_earlier_runs(spark):
    from threadspark.plans import views as V

    bad = spark.createDataFrame(  # parameters that are rejected before any training
        [(4, 500, 1, 20, 0.7, "symmetric", "symmetric", 2, 0.6, 20, 20000, 2, 0, "default", "post", 5)] * 2,
        ", ".join(f"{n} {t.simpleString()}" for n, t in S.TRIAL_PARAM_FIELDS),
    ).withColumn("phraser_scorer", F.lit("default")).withColumn("phraser_threshold", F.lit(-1).cast("double"))
    bad = bad.select(*[F.col(n).cast(t) for n, t in S.TRIAL_PARAM_FIELDS])
    log = tempfile.mkdtemp(prefix="ts-log-") + "/trials"
    for _ in range(2):
        S.run_search(V.forest(spark, "/root/testdata/sf0.001"), log, n_trials=2, seeds=bad, seed_count=2, parallel=2)
    assert RD.read_trials(spark, log).count() == 4


def test_search_loop_records_failures(spark):
    from threadspark.plans import views as V

    seeds = spark.createDataFrame(
        [(4, 500, 1, 20, 0.7, "symmetric", "symmetric", 2, 0.6, 20, 20000, 2, 0, "default", "post", 5),
         (3, 500, 1, 20, 0.7, "asymmetric", "auto", 2, 0.6, 20, 20000, 2, 5, "default", "post", 5)],
        ", ".join(f"{n} {t.simpleString()}" for n, t in S.TRIAL_PARAM_FIELDS),
    )
    log = tempfile.mkdtemp(prefix="ts-log-") + "/trials"
    S.run_search(V.forest(spark, "/root/testdata/sf0.001"), log, n_trials=2, seeds=seeds, seed_count=2, parallel=2)
    rows = RD.read_trials(spark, log).collect()
    assert sorted(r.status for r in rows) == ["invalid_params", "ok"]
    ok = [r for r in rows if r.status == "ok"][0]
    assert ok.diversity is not None and 0 < ok.diversity <= 1
    assert ok.avg_entropy >= 0 and ok.stability_score >= 0 and ok.perplexity < 0
    assert ok.model_training_time > 0


def test_predictive_search(spark):
    rows = [(float(i % 7), float(i % 5), "a" if i % 2 else "b", float(i % 7) * 2 + (1 if i % 2 else 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, c string, total_score double")
    out = S.predictive_search(df, {"y": 1.0}, "total_score", ["x", "y", "c"], iterations=50, max_iter=5, max_depth=3)
    res = out.collect()
    assert len(res) == 50 and all(r.y == 1.0 for r in res)
    preds = [r.predicted_score for r in res]
    assert preds == sorted(preds)
    assert set(S.seed_trials(out, 3).columns) == {"x", "y", "c"}
    assert set(TRIAL_PARAMS) == {n for n, _ in S.TRIAL_PARAM_FIELDS}


def test_a_stopped_search_goes_on(spark, monkeypatch):
    import pytest

    from threadspark.sources import writers as WR

    ran, stop_at = [], [5]

    def trial(units, params, seed=0, **_):
        if len(ran) == stop_at[0]:
            raise KeyboardInterrupt
        ran.append(params["trial_id"])
        return {**{n: params[n] for n in TRIAL_PARAMS}, "status": "ok" if seed % 2 else "error"}

    monkeypatch.setattr(S, "run_trial", trial)
    units = spark.createDataFrame([("a", None, True)], "id string, parent_id string, is_post boolean")
    log = tempfile.mkdtemp(prefix="ts-log-") + "/trials"
    seeds = S.random_trials(spark, 3, seed=99).drop("trial")
    go = lambda **k: S.run_search(units, log, n_trials=13, seeds=seeds, seed_count=3, seed=1, resume=True, batch=4, **k)
    with pytest.raises(KeyboardInterrupt):
        go()
    assert len(ran) == 5 and RD.read_trials(spark, log).count() == 5  # what was finished is in the log
    stop_at[0] = None
    go(parallel=3)
    plan = [r.trial_id for r in S.search_plan(spark, 13, seeds, 3, 1).orderBy("number").collect()]
    assert sorted(ran) == sorted(plan) == sorted(r.trial_id for r in RD.read_trials(spark, log).collect()) and len(set(plan)) == 13
    assert ran[:5] == plan[:5]
    assert len(RD.read_trials(spark, log).inputFiles()) <= 5  # two batches and a rest before the stop, then two of four
    go()
    assert len(ran) == 13  # nothing left to do
    S.run_search(units, log, n_trials=2, seed=1)
    WR.compact_trials(spark, log, log + "-small")
    small = RD.read_trials(spark, log + "-small")
    assert len(small.inputFiles()) == 1 and small.count() == small.select("trial_id").distinct().count() == 15
    assert small.select(*TRIAL_PARAMS).exceptAll(RD.read_trials(spark, log).select(*TRIAL_PARAMS)).isEmpty()


def test_predictive_search_on_the_trial_columns(spark):
    """H5/H8 with all 16 parameters: 12 numeric ones with their products and 4 categorical ones."""
    trials = S.random_trials(spark, 90, seed=5)
    score = F.col("lda_num_topics") * 2.0 + F.when(F.col("dataset") == "chain", 40.0).otherwise(0.0)
    out = S.predictive_search(trials.withColumn("total_score", score), {"passes": 3, "eta": "auto"}, iterations=60, ascending=False, max_iter=4, max_depth=3)
    rows = out.collect()
    assert len(rows) == 60 and set(out.columns) == {*TRIAL_PARAMS, "predicted_score"} and all(r.passes == 3 and r.eta == "auto" for r in rows)
    preds = [r.predicted_score for r in rows]
    assert preds == sorted(preds, reverse=True) and rows[0].dataset == "chain" and rows[-1].dataset != "chain"
    plan = S.search_plan(spark, 5, out, 2, seed=1).collect()
    assert len(plan) == 5 and len({r.trial_id for r in plan}) == 5
