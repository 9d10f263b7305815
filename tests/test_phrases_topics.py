"""Phrases, vocabulary and topic metrics against brute-force Python versions."""

import math
import os
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadspark.operators import phrases as PH
from threadspark.operators import topics as TP
from threadspark.operators import vocab as VB


def _docs(spark, docs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, tokens array<string>")


def _greedy(doc, phrases):
    out, i = [], 0
    while i < len(doc):
        if i + 1 < len(doc) and (doc[i], doc[i + 1]) in phrases:
            out.append(doc[i] + "_" + doc[i + 1])
            i += 2
        else:
            out.append(doc[i])
            i += 1
    return out


def _apply(spark, docs, phrases):
    ph = spark.createDataFrame(sorted(phrases), "a string, b string")
    res = PH.apply_phrases(_docs(spark, docs), ph).collect()
    return {r.doc_id: list(r.phrased) for r in res}


def test_greedy_f10(spark):
    got = _apply(spark, [["a", "b", "a", "b", "c"], ["a", "b", "b"], ["c", "a", "b"], []], {("a", "b")})
    assert got == {0: ["a_b", "a_b", "c"], 1: ["a_b", "b"], 2: ["c", "a_b"], 3: []}
    assert _apply(spark, [["a", "b", "a"]], {("a", "b"), ("b", "a")}) == {0: ["a_b", "a"]}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=6),
       st.sets(st.tuples(st.sampled_from("abc"), st.sampled_from("abc")), max_size=4))
def test_greedy_bruteforce(spark, docs, phrases):
    got = _apply(spark, docs, phrases)
    assert got == {i: _greedy(d, phrases) for i, d in enumerate(docs)}
    # no token is lost: joined phrases account for every input token
    for i, d in enumerate(docs):
        assert sum(1 + t.count("_") for t in got[i]) == len(d)


def test_vocabulary_keys_that_meet(spark):
    """V counts a key once, however it comes about: words holding the delimiter, empty and null words too."""
    rng = random.Random(11)
    words = ["a", "b", "a_b", "_", "a_", "_b", "b_a", "a_b_a", "", "__", None]
    docs = [[rng.choice(words) for _ in range(rng.randint(0, 6))] for _ in range(12)]
    for n in (1, 4, 12):
        uni = {w for d in docs[:n] for w in d}
        bi = {(a, b) for d in docs[:n] for a, b in zip(d, d[1:])}
        keys = {w for w in uni if w is not None} | {f"{a}_{b}" for a, b in bi if a is not None and b is not None}
        u = spark.createDataFrame([(w,) for w in uni], "w string")
        pairs = spark.createDataFrame([p for p in bi if p[1] is not None], "a string, b string")
        assert spark.range(1).select(PH._vocabulary_size(u, pairs).alias("v")).first().v == len(keys)


def test_seldom_bigrams_meet_no_words(spark):
    """Bigrams too seldom to score are dropped before the joins with their words."""
    docs = _docs(spark, [["a", "b", "c"], ["a", "b"]])
    for scoring, bound in (("default", "> 1"), ("npmi", ">= 1")):
        plan = PH.learn_phrases(docs, min_count=1, threshold=0.5, scoring=scoring)._jdf.queryExecution().optimizedPlan().toString()
        lowest = plan[plan.rindex("Join Inner") :]
        assert bound in lowest[: lowest.index("LogicalRDD")]


def test_phrase_scores_bruteforce(spark):
    rng = random.Random(5)
    docs = [[rng.choice("abcdef") for _ in range(rng.randint(0, 15))] for _ in range(40)]
    uni, bi = {}, {}
    for d in docs:
        for w in d:
            uni[w] = uni.get(w, 0) + 1
        for a, b in zip(d, d[1:]):
            bi[(a, b)] = bi.get((a, b), 0) + 1
    vocab = len(set(uni) | {a + "_" + b for a, b in bi})
    total = sum(uni.values())
    exp_default = {k: (n - 1) / (uni[k[0]] * uni[k[1]]) * vocab for k, n in bi.items()}
    got = {(r.a, r.b): r.score for r in PH.learn_phrases(_docs(spark, docs), min_count=1, threshold=0.01).collect()}
    assert got == {k: v for k, v in exp_default.items() if v > 0.01}

    def npmi(k, n):
        pab, pa, pb = n / total, uni[k[0]] / total, uni[k[1]] / total
        return math.log(pab / (pa * pb)) / -math.log(pab)

    got = {(r.a, r.b): r.score for r in PH.learn_phrases(_docs(spark, docs), min_count=3, threshold=-0.5, scoring="npmi").collect()}
    exp = {k: npmi(k, n) for k, n in bi.items() if n >= 3 and npmi(k, n) > -0.5}
    assert got.keys() == exp.keys() and all(abs(got[k] - exp[k]) < 1e-12 for k in exp)


def test_invalid_phrase_params(spark):
    import pytest

    with pytest.raises(ValueError):
        PH.learn_phrases(_docs(spark, [["a"]]), threshold=0, scoring="default")
    with pytest.raises(ValueError):
        PH.learn_phrases(_docs(spark, [["a"]]), threshold=2, scoring="npmi")


def test_vocabulary_filter(spark):
    docs = [["a", "b"], ["a", "c"], ["a", "b"], ["d"]]
    v = {r.term: (r.term_id, r.df) for r in VB.build_vocabulary(_docs(spark, docs), no_below=2, no_above=0.5).collect()}
    assert v == {"b": (0, 2)}  # a: df 3 > floor(0.5*4); c, d: df 1 < 2


def _topics(spark, rows):
    return spark.createDataFrame(rows, "topic string, term_id long, weight double")


def _hellinger(p, q):
    keys = set(p) | set(q)
    return math.sqrt(0.5 * sum((math.sqrt(p.get(k, 0)) - math.sqrt(q.get(k, 0))) ** 2 for k in keys))


def test_hellinger_min_bruteforce(spark):
    rng = random.Random(7)
    run1, run2 = {}, {}
    for runs, prefix in ((run1, "x"), (run2, "y")):
        for t in range(6):
            terms = rng.sample(range(12), 4)
            runs[f"{prefix}{t}"] = {k: rng.random() / 4 for k in terms}
    rows1 = [(t, k, w) for t, d in run1.items() for k, w in d.items()]
    rows2 = [(t, k, w) for t, d in run2.items() for k, w in d.items()]
    got = {r.topic: r.min_hellinger for r in TP.hellinger_min(_topics(spark, rows1), _topics(spark, rows2)).collect()}
    for t, p in run1.items():
        assert abs(got[t] - min(_hellinger(p, q) for q in run2.values())) < 1e-9
    same = {r.topic: r.min_hellinger for r in TP.hellinger_min(_topics(spark, rows1), _topics(spark, rows1)).collect()}
    assert all(abs(v) < 1e-6 for v in same.values())  # a model is stable against itself


def test_umass_bruteforce(spark):
    docs = [{1, 2, 3}, {1, 2}, {2, 3}, {3}, {1, 4}]
    top = spark.createDataFrame([("t", 0, 1), ("t", 1, 2), ("t", 2, 3)], "topic string, rank int, term_id long")
    occ = spark.createDataFrame([(i, w) for i, d in enumerate(docs) for w in d], "doc_id long, term_id long")
    got = TP.umass_coherence(top, occ, len(docs)).first().coherence
    n = len(docs)
    D = lambda *ws: sum(1 for d in docs if set(ws) <= d)
    terms = [1, 2, 3]
    pairs = [(terms[i], terms[j]) for i in range(1, 3) for j in range(i)]
    exp = sum(math.log((D(a, b) / n + 1e-12) / (D(b) / n)) for a, b in pairs) / len(pairs)
    assert abs(got - exp) < 1e-12


def test_entropy_and_diversity(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([1.0, 0.0],), ([0.995, 0.005],)], "p array<double>")
    got = [r.e for r in df.select(TP.distribution_entropy(F.col("p")).alias("e")).collect()]
    assert abs(got[0] - math.log(2)) < 1e-12 and got[1] == 0.0 and abs(got[2] + 0.995 * math.log(0.995)) < 1e-12
    top = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "topic string, term_id long")
    assert TP.topic_diversity(top).first()[0] == 0.75


def test_alpha_vectors():
    v = TP.alpha_vector("asymmetric", 4)
    assert abs(sum(v) - 1) < 1e-12 and v == sorted(v, reverse=True)
    assert TP.alpha_vector("symmetric", 4) == [0.25] * 4


def _vectors(spark, n=60, vocab=30, seed=3):
    """Token lists and their vectors; the last document has no known term."""
    rng = random.Random(seed)
    docs = [[f"t{rng.randrange(vocab)}" for _ in range(rng.randint(1, 40))] for _ in range(n)] + [["other"]]
    v = spark.createDataFrame([(f"t{i}", i, 1) for i in range(vocab)], "term string, term_id int, df long")
    return _docs(spark, docs), v


def test_perplexity_looks_up_the_documents_terms_only(spark):
    """the bound is MLlib's, from one inference per document and without the whole model per document."""
    docs, vocab = _vectors(spark)
    vectors = VB.bow_vectors(docs, vocab).cache()
    model = TP.lda_estimator(k=3, n_docs=61, chunksize=20, passes=3).fit(vectors)
    bounds = TP.doc_bounds(model, vectors)
    got = spark.range(1).select(TP.log_perplexity(model, bounds)).first()[0]
    assert abs(got / model.logPerplexity(vectors) - 1) < 1e-4
    assert {r.doc_id: r.entropy for r in TP.doc_entropy(model, vectors, inferred=bounds).collect()} == {
        r.doc_id: r.entropy for r in TP.doc_entropy(model, vectors).collect()
    }
    assert abs(float(TP._digamma(1.0)) + 0.5772156649015329) < 1e-12 and abs(float(TP._digamma(0.01)) + 100.56088545786868) < 1e-10


def test_vectors_of_a_bounded_vocabulary_need_no_shuffle(spark, monkeypatch):
    """tokens are counted where they are read; rows that share an id, and larger vocabularies, are counted by joins, alike."""
    docs, vocab = _vectors(spark)
    plan = VB.bow_vectors(docs, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    short = {r.doc_id: r.features for r in VB.bow_vectors(docs, vocab).collect()}
    monkeypatch.setattr(VB, "LOOKUP_TERMS", 5)
    assert short == {r.doc_id: r.features for r in VB.bow_vectors(docs, vocab).collect()} and len(short) == 61
    monkeypatch.undo()
    twice = {r.doc_id: r.features for r in VB.bow_vectors(docs.union(docs), vocab).collect()}
    assert {i: (list(v.indices), list(v.values * 2)) for i, v in short.items()} == {i: (list(v.indices), list(v.values)) for i, v in twice.items()}


def test_vectors_lie_in_two_tasks_per_core(spark):
    """every task of an update sends a whole model, so their number doesn't follow the shuffle partitions."""
    docs, vocab = _vectors(spark, n=5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert TP.spread(VB.bow_vectors(docs, vocab)).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_phrases_are_looked_up_where_texts_are_read(spark, monkeypatch):
    """few phrases are broadcast, so only the pairs that are phrases are shuffled; many are met by a shuffle, alike."""
    docs = _docs(spark, [["a", "b", "a", "b", "c"], ["a", "b", "b"], ["c", "a", "b"], []])
    texts = docs.select("doc_id", F.array_join("tokens", " ").alias("text"))
    ph = spark.createDataFrame([("a", "b")], "a string, b string")
    tokens = F.filter(F.split("text", " "), lambda t: t != "")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = PH.apply_phrases(docs, ph)._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin [a" in plan and plan.count("SortMergeJoin") == 1
        # texts, not their tokens, are moved to their edits
        plan = PH.apply_phrases(texts, ph, tokens_col=tokens)._jdf.queryExecution().executedPlan().toString()
        moved = plan[plan.index("SortMergeJoin") : plan.index("Generate")]
        assert "text#" in moved and "split(text" not in moved
        got = [PH.apply_phrases(docs, ph), PH.apply_phrases(texts, ph, tokens_col=tokens)]
        monkeypatch.setattr(PH, "LOOKUP_ROWS", 0)
        got.append(PH.apply_phrases(docs, ph))
        assert "BroadcastHashJoin" not in got[-1]._jdf.queryExecution().sparkPlan().toString()
        for g in got:
            assert {r.doc_id: list(r.phrased) for r in g.collect()} == {0: ["a_b", "a_b", "c"], 1: ["a_b", "b"], 2: ["c", "a_b"], 3: []}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_counts_are_held_compressed_and_their_shuffle_is_dropped(spark):
    """the counts of all bigrams lie in a Parquet table, not in a checkpoint."""
    plan = PH.learn_phrases(_docs(spark, [["a", "b", "c"], ["a", "b"]]), threshold=0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan
    from threadspark import session

    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in dirs for _, _, names in os.walk(str(d)) for f in names if f.startswith("shuffle_")}

    before = files()
    t = session.stored(spark.range(10).selectExpr("id", "string(id) AS s").repartition(3, "s"))
    assert spark.conf.get(session._CLEANUP_KEY) == "false"
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before
    assert sorted(map(tuple, t.collect())) == [(i, str(i)) for i in range(10)]
