from pyspark.sql import functions as F

from threadspark.functions import html as H

F4 = [
    ("f1", '<div class="md"><p>Hello <em>big</em> <a href="http://x">link</a>.</p>\n<p><span>gone</span>two</p></div>',
     ["Hello *big* [link](http://x) .", "two"], "Hello *big* [link](http://x) .\ntwo\nhide", "Hello *big* [link](http://x).\ntwo"),
    ("f2", "<div>no paragraphs</div>", [], "\nhide", ""),
    ("f3", '<p>a <a href="/e"></a>b</p><p>c &amp; d</p>', ["a b", "c & d"], "a b\nc & d\nhide", "a b\nc & d"),
    ("f4", "<p> x\n <strong>y</strong> z </p>", ["x y z"], "x y z\nhide", "x y z"),
    ("f5", '<p>foo <a href="/q">ba <b>r</b></a></p>', ["foo [bar](/q)"], "foo [bar](/q)\nhide", "foo [bar](/q)"),
    ("f6", "<p>a <span>b<span>c</span>d</span> e</p>", ["a e"], "a e\nhide", "a e"),
    ("f7", "<p>one &mdash; two&hellip; it&#8217;s &#x2014; &amp;lt; &copy 3 &nosuch; &</p>",
     ["one — two… it’s — &lt; © 3 &nosuch; &"], "one — two… it’s — &lt; © 3 &nosuch; &\nhide", "one — two… it’s — &lt; © 3 &nosuch; &"),
    ("f8", "<p>before<div>in <span>deep <div>er</div></span></div>after <div class='x'><em>gone</em></div> end</p>",
     ["before after end"], "before after end\nhide", "before after end"),
]
F4_SPARK = [
    ("s1", "<p>a <span>b <div>c</span> d</p>", ["a d"]),  # the end tag of the outer element ends the inner one too
    ("s2", "<p>a </div> b <span>c", ["a b"]),  # stray end tag; element without an end
    ("s3", "<p>a<span/>b <div class=x><p>c</p></div> d</p>", ["a b", "c"]),
    ("s4", "<p>&#0;&#xD800;&#1114112;&#99999999999999999999;&#x80;&#128512;&#x1F600;</p>", ["\ufffd" * 4 + "€😀😀"]),
    ("s5", "<p>&NotEqualTilde;&notit; &fjlig;&amp&lt</p>", ["≂̸&notit; fj&<"]),
    ("s6", "", []),
    ("s7", "<p>" + "<div>" * 300 + "x" + "</div>" * 300 + "y</p>", ["y"]),
]


def test_nested_elements_and_references(spark):
    df = spark.createDataFrame([(k, h) for k, h, _ in F4_SPARK] + [("null", None)], "k string, html string")
    got = {r.k: r.p for r in df.select("k", H.html_to_paragraphs(F.col("html")).alias("p")).collect()}
    assert got.pop("null") is None
    assert {k: list(v) for k, v in got.items()} == {k: e for k, _, e in F4_SPARK}


def test_every_named_reference(spark):
    import html as stdlib
    from html.entities import html5

    names = sorted(html5)
    df = spark.createDataFrame([(i, f"x&{n} y") for i, n in enumerate(names)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", H.decode_entities(F.col("t")).alias("d")).collect()}
    assert all(got[i] == stdlib.unescape(f"x&{n} y") for i, n in enumerate(names))


def test_f4_fixture(spark):
    df = spark.createDataFrame([(k, h) for k, h, *_ in F4], "k string, html string")
    out = df.select(
        "k",
        H.html_to_paragraphs(F.col("html")).alias("paras"),
        H.html_to_source(F.col("html")).alias("src"),
        H.clean_source(H.html_to_source(F.col("html"))).alias("clean"),
    ).collect()
    got = {r.k: (list(r.paras), r.src, r.clean) for r in out}
    for k, _, paras, src, clean in F4:
        assert got[k] == (paras, src, clean), k


def test_clean_source_quirks(spark):
    df = spark.createDataFrame(
        [("chide",), ("a hide,\n hide",), ("x\n\n\ny",), ("a .\nb",), ("   z　 ",)], "t string"
    )
    got = [r[0] for r in df.select(H.clean_source(F.col("t"))).collect()]
    assert got == ["c", "a", "x\n\ny", "a.\nb", "z"]


def test_f4_fixture_duckdb():
    import duckdb

    from threadspark.plans import duck as D

    con = duckdb.connect()
    for k, html, paras, src, clean in F4:
        row = con.execute(
            f"SELECT {D.html_to_paragraphs('h')}, {D.html_to_source('h')}, {D.clean_source(D.html_to_source('h'))} "
            f"FROM (SELECT ? AS h)",
            [html],
        ).fetchone()
        assert (list(row[0]), row[1], row[2]) == (paras, src, clean), k


def test_pages_spark_equals_duckdb(spark, duck):
    from threadspark.plans import duck as D

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {
        r.page_id: (list(r.p), r.s, r.t)
        for r in pages.select(
            "page_id",
            H.html_to_paragraphs(F.col("html")).alias("p"),
            H.clean_source(H.html_to_source(F.col("html"))).alias("s"),
            H.html_title(F.col("html")).alias("t"),
        ).collect()
    }
    exp = {
        r[0]: (list(r[1]), r[2], r[3])
        for r in duck.execute(
            f"SELECT page_id, {D.html_to_paragraphs('html')}, {D.clean_source(D.html_to_source('html'))}, "
            f"{D.html_title('html')} FROM pages"
        ).fetchall()
    }
    assert got == exp
    assert sum(len(v[0]) for v in got.values()) > 1000
