"""Remaining sinks: predictions (K3), pages (K5), link map (K6), topic model + vocabulary (K7)."""

import tempfile

from pyspark.sql import functions as F

from threadspark.functions.text import tokenize
from threadspark.operators import topics as TP
from threadspark.operators import vocab as VB
from threadspark.sources import readers as RD
from threadspark.sources import writers as WR


def test_model_and_table_sinks(spark):
    tmp = tempfile.mkdtemp(prefix="ts-k-")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", tokenize(F.col("text")).alias("tokens"))
    vocab = VB.build_vocabulary(docs, no_below=2, no_above=0.5)
    vectors = VB.bow_vectors(docs, vocab)
    model = TP.lda_estimator(k=3, n_docs=vectors.count(), passes=1, chunksize=100, seed=1).fit(vectors)
    WR.save_topic_model(model, vocab, f"{tmp}/model")
    loaded, lvocab = WR.load_topic_model(spark, f"{tmp}/model")
    assert loaded.vocabSize() == model.vocabSize() == lvocab.count()
    a = [r.termIndices for r in model.describeTopics(5).orderBy("topic").collect()]
    b = [r.termIndices for r in loaded.describeTopics(5).orderBy("topic").collect()]
    assert a == b

    pred = spark.createDataFrame([(1.0, "post", 0.5)], "x double, dataset string, predicted_score double")
    WR.write_predictions(pred, f"{tmp}/pred.csv", fmt="csv")
    WR.write_predictions(pred, f"{tmp}/pred")
    assert [RD.read_predictions(spark, f"{tmp}/pred{x}", pred.schema, f).collect() for x, f in ((".csv", "csv"), ("", "parquet"))] == [pred.collect()] * 2

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("batch", F.col("page_id") % 3)
    WR.write_pages(pages, f"{tmp}/pages", partition_col="batch")
    assert spark.read.parquet(f"{tmp}/pages").where("batch = 1").count() == pages.where("batch = 1").count()
    stored = RD.read_saved_pages(spark, f"{tmp}/pages", fmt="parquet")
    assert sorted(map(tuple, stored.collect())) == sorted((str(r.page_id), r.html) for r in pages.select("page_id", "html").collect())

    links = spark.createDataFrame([("a", "u1"), ("b", "u2")], "post_id string, url string")
    WR.write_link_map(links, f"{tmp}/links")
    WR.write_link_map(links.where("post_id = 'a'"), f"{tmp}/links")  # replaced as a whole
    assert [tuple(r) for r in RD.read_link_map(spark, f"{tmp}/links", fmt="parquet").collect()] == [("a", "u1")]


def test_vectors_equal_the_counts(spark):
    from threadspark.operators import vocab as VB

    docs = spark.createDataFrame([(1, ["a", "b", "a", "zz"]), (2, ["c"]), (3, []), (4, None), (None, ["b", "b"])], "doc_id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 2, 1), ("b", 0, 2), ("c", 1, 1)], "term string, term_id int, df long")
    got = {r.doc_id: (r.features.size, dict(zip(r.features.indices.tolist(), r.features.values.tolist()))) for r in VB.bow_vectors(docs, vocab).collect()}
    assert got == {1: (3, {0: 1.0, 2: 2.0}), 2: (3, {1: 1.0}), 3: (3, {}), 4: (3, {}), None: (3, {0: 2.0})}
    model = VB.vectorizer(vocab, "tokens").transform(docs.where("tokens IS NOT NULL"))
    assert all(got[r.doc_id][1] == dict(zip(r.features.indices.tolist(), r.features.values.tolist())) for r in model.collect())


def test_lda_updates_once_per_two_chunks_of_a_core_and_uses_all_cores(spark, monkeypatch):
    from threadspark.plans import catalog as K

    fits = []

    class Fit:
        def __init__(self, **given):
            self.given = given

        def fit(self, vectors):
            fits.append((self.given, vectors.rdd.getNumPartitions()))

    monkeypatch.setattr(TP, "LDA", Fit)
    monkeypatch.setattr(K, "LDA_PARAMS", {**K.LDA_PARAMS, "chunksize": 2})
    K._lda_model(spark, "/root/testdata/sf0.001")
    cores = spark.sparkContext.defaultParallelism
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    (given, parts), batch = fits[0], 2 * cores * 2
    assert given["maxIter"] == K.LDA_PARAMS["passes"] * -(-n // batch) and given["subsamplingRate"] == min(1.0, batch / n)
    assert parts >= 2 * cores
