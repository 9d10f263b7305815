"""Link harvesting, upsert, work-lists, sampling and corpus length bounds."""

from pyspark.sql import functions as F

from threadspark.operators import corpus as C
from threadspark.operators import pages as P
from threadspark.schemas import CONTENT_SCHEMA

F5 = [
    ("https://h/r/S/comments/abc/t/", "1,204 comments", True),
    ("https://h/r/S/comments/abd/t/", "49 comments", False),
    ("https://h/r/S/comments/abe/t/", "50 comments", True),
    ("https://h/r/S/comments/abf/t/", "Can 90 comments", False),
    ("https://h/r/S/other/abg/t/", "90 comments", False),
    ("https://h/r/S/comments/abh/t/", "many comments", False),
]


def test_listing_page_f5(spark):
    html = "".join(f'<a href="{h}">{t}</a>' for h, t, _ in F5) + "<a>90 comments</a>"
    pages = spark.createDataFrame([(1, "https://h/r/S/", html)], "page_id long, url string, html string")
    links = P.anchors(pages)
    assert links.count() == 7
    kept = sorted(r.post_id for r in P.harvest_post_links(links).collect())
    assert kept == ["abc", "abe"]


def test_relative_links(spark):
    pages = spark.createDataFrame([(1, "https://h.example/a/b?x=1", '<a href="/r">x</a><a href="c">y</a><a href="//o/p">z</a>')],
                                  "page_id long, url string, html string")
    got = [r.href for r in P.anchors(pages).orderBy("pos").collect()]
    assert got == ["https://h.example/r", "https://h.example/a/c", "https:///o/p".replace("///", "//")]


def test_upsert_f8(spark):
    cur = spark.createDataFrame([("abc", "old", 1), ("keep", "k", 2)], "post_id string, url string, seq long")
    upd = spark.createDataFrame([("abc", "new", 0), ("abd", "d", 1), ("abd", "d2", 2)], "post_id string, url string, seq long")
    got = {r.post_id: r.url for r in P.upsert_links(cur, upd).collect()}
    assert got == {"abc": "new", "keep": "k", "abd": "d2"}


def test_worklist(spark):
    links = spark.createDataFrame([(i, f"u{i}") for i in range(6)], "post_id long, url string")
    done = spark.createDataFrame([(0,), (1,), (2,)], "post_id long")
    saved = spark.createDataFrame([(1,), (3,)], "post_id long")
    assert sorted(r.post_id for r in P.worklist(links, done, saved).collect()) == [1, 3, 4, 5]
    assert sorted(r.post_id for r in P.worklist(links, done, saved, cached_only=True).collect()) == [1, 3]


def test_sample_rows_deterministic(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a = [r.k for r in P.sample_rows(df, "k", 10, seed=3).collect()]
    b = [r.k for r in P.sample_rows(df, "k", 10, seed=3).collect()]
    assert a == b and len(set(a)) == 10
    assert P.sample_rows(df, "k", 1000).count() == 100


def _units(spark, texts, titles=None):
    rows = []
    for i, t in enumerate(texts):
        title = titles[i] if titles else None
        rows.append(("u", None, None, None, None, "usr", t, "d", None, str(i), None, title is not None, title))
    return spark.createDataFrame(rows, CONTENT_SCHEMA)


def test_length_bounds_f11(spark):
    lengths = [49, 50, 51, 999, 1000, 1001]
    raw = ["x" * n for n in lengths]
    u = _units(spark, [f"<p>{t}</p>" for t in raw])
    para = sorted(len(r.doc) for r in C.paragraph_corpus(u).collect())
    assert para == [51, 999]
    html_u = _units(spark, raw)
    assert sorted(len(r.doc) for r in C.html_corpus(html_u).collect()) == [50, 51, 999, 1000]
    # source corpus counts the '\nhide' suffix (5 characters)
    src = _units(spark, [f"<p>{'x' * (n - 5)}</p>" for n in lengths])
    assert sorted(len(r.doc) for r in C.source_corpus(src).collect()) == [50, 51, 999, 1000]


def test_build_corpus_dispatch(spark):
    import pytest

    u = _units(spark, ["<p>" + "y" * 80 + "</p>"], ["a title that is long enough to pass the bound"])
    assert C.build_corpus(u, "post").count() == 1
    with pytest.raises(ValueError):
        C.build_corpus(u, "tweets")


def test_chain_corpus_moves_no_chain_again(spark):
    """chains are whole when the walk ends: leaves and heads are met before it, no join follows. Repeated and null ids count as before."""
    rows = [("p", None, True, "T", "u"), ("c", "p", False, None, "v"), ("c", "p", False, None, "w"), ("d", "c", False, None, "x"),
            ("lone", None, True, None, None), ("o", "gone", False, None, "y"), (None, "p", False, None, "z"), (None, None, True, "N", "n")]
    full = [("url", None, None, "", None, user, f"<p>{i} {user}</p>", "d", None, i, p, post, title) for i, p, post, title, user in rows]
    out = C.chain_corpus(spark.createDataFrame(full, CONTENT_SCHEMA), 0, 10_000)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    head = "u says:\n T\n p u\nhide"
    want = [("d", f"{head}\n c v\nhide\n d x\nhide"), ("d", f"{head}\n c w\nhide\n d x\nhide"), ("lone", "None says:\n lone None\nhide")]
    assert sorted((r.chain_id, r.doc) for r in out.collect()) == want
