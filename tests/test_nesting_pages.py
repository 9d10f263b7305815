"""Nested JSON thread files (flatten/nest, sources) and thread pages (parse/render)."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from threadspark.operators import nesting as N
from threadspark.operators import threadpages as TPG
from threadspark.schemas import CONTENT_COLUMNS
from threadspark.sources import readers as RD
from threadspark.sources import writers as WR


def _unit(id, parent, user, text, is_post=False, title=None, replies=()):
    return {"url": "u", "subreddit": "S", "source_text": "", "author_tag": "", "tag": None, "user": user, "text": text,
            "date": "d", "upvotes": 12, "id": id, "parent_id": parent, "is_post": is_post, "title": title,
            "replies": list(replies)}


def _f1():
    c2 = _unit("c2", "c1", "cat", "<p>two</p>")
    c3 = _unit("c3", "c1", "dan", "<p>three</p>")
    c1 = _unit("c1", "p1", "bob", "<p>one</p>", replies=[c2, c3])
    c4 = _unit("c4", "p1", "eve", "<p>four</p>")
    root = _unit("p1", None, "ann", "<p>root</p>", True, "T")
    root["replies"] = [None, c1, c4]
    return root


def _write_f1(tmp):
    os.makedirs(os.path.join(tmp, "sub"), exist_ok=True)
    with open(os.path.join(tmp, "sub", "p1.json"), "w") as f:
        json.dump(_f1(), f, indent=1)  # a document of many lines
    bad = _unit("q1", None, "x", "<p>q</p>", True, "Q")
    del bad["date"]  # missing required field -> rejected row
    with open(os.path.join(tmp, "q1.json"), "w") as f:
        json.dump(bad, f)
    with open(os.path.join(tmp, "notes.JSON"), "w") as f:  # suffix match is case-sensitive
        f.write("{}")


def test_flatten_f1_files(spark):
    tmp = tempfile.mkdtemp(prefix="ts-f1-")
    _write_f1(tmp)
    flat = RD.read_threads(spark, tmp)
    rows = flat.orderBy("thread", "path").collect()
    assert [r.id for r in rows] == ["p1", "c1", "c2", "c3", "c4"]
    assert [r.parent_id for r in rows] == [None, "p1", "c1", "c1", "p1"]
    assert RD.thread_files(spark, tmp).count() == 2
    assert RD.read_threads(spark, tmp, max_docs=1).select("thread").distinct().count() <= 1


def test_nest_flatten_roundtrip(spark):
    from threadspark.plans import views as V

    u = V.conv(spark, "/root/testdata/sf0.001")
    docs = N.nest_threads(u).withColumnRenamed("id", "thread")
    back = N.flatten_threads(docs, "json", "thread").select(*CONTENT_COLUMNS)
    assert back.exceptAll(u).count() == 0 and u.exceptAll(back).count() == 0


def test_sinks_and_sources(spark):
    from threadspark.operators import threads as T
    from threadspark.plans import views as V

    tmp = tempfile.mkdtemp(prefix="ts-sink-")
    chains = T.chain_table(V.conv(spark, "/root/testdata/sf0.001"), with_children_ids=True)
    WR.write_chain_table(chains, f"{tmp}/chains.parquet")
    WR.write_chain_table(chains, f"{tmp}/chains.csv", fmt="csv")
    a = RD.read_chain_table(spark, f"{tmp}/chains.parquet")
    b = RD.read_chain_table(spark, f"{tmp}/chains.csv", fmt="csv")
    assert a.count() == b.count() == chains.count()
    assert RD.chain_head(a, 50).count() == min(50, chains.count())
    assert RD.read_trials(spark, f"{tmp}/missing").count() == 0
    with open(f"{tmp}/links.json", "w") as f:
        json.dump({"abc": "https://h/r/S/comments/abc/t/"}, f)
    assert [tuple(r) for r in RD.read_link_map(spark, f"{tmp}/links.json").collect()] == [("abc", "https://h/r/S/comments/abc/t/")]
    os.makedirs(f"{tmp}/pages")
    with open(f"{tmp}/pages/abc.html", "w") as f:
        f.write("<html></html>")
    assert [r.page_id for r in RD.read_saved_pages(spark, f"{tmp}/pages").collect()] == ["abc"]
    WR.write_thread_documents(V.conv(spark, "/root/testdata/sf0.001"), f"{tmp}/threads")
    assert spark.read.text(f"{tmp}/threads").count() == V.conv(spark, "/root/testdata/sf0.001").where("is_post").count()
    back = RD.read_threads(spark, f"{tmp}/threads", fmt="lines")
    key = lambda d: sorted((r.id, r.parent_id or "") for r in d.select("id", "parent_id").collect())
    assert key(back) == key(V.conv(spark, "/root/testdata/sf0.001")) and back.where("thread IS NULL").isEmpty()


F6 = """<html><body>
<div class="top-matter"><p class="title"><a class="title" href="/x">Post title</a>
<span class="linkflairlabel">Meta</span></p>
<p class="tagline">by <a class="author" href="/u/op">op</a><span class="flair">OP flair</span></p></div>
<span class="score unvoted">42 points</span><time title="T0">t</time>
<div id="thing_t3_abc"><div class="md"><p>post body</p></div></div>
<div id="siteTable_t3_abc">
 <div data-type="comment" data-fullname="t1_k1" data-permalink="/r/S/comments/abc/t/k1/">
   <p class="tagline"><span class="score unvoted">score hidden</span><time title="T1">t</time></p>
   <div class="md"><p>no author here</p></div>
   <div id="siteTable_t1_k1">
     <div data-type="comment" data-fullname="t1_k2" data-permalink="/r/S/comments/abc/t/k2/">
       <p class="tagline"><a class="author">replier</a><span class="flair">F</span><span class="score unvoted">-3 points</span><time title="T2">t</time></p>
       <div class="md"><p>reply</p></div><div id="siteTable_t1_k2"></div></div>
   </div></div>
 <div data-type="comment" data-permalink="/r/S/comments/abc/t/none/">
   <div class="md"><p>no id</p></div>
   <div id="siteTable_t1_">
     <div data-type="comment" data-fullname="t1_k4"><div class="md"><p>child of id-less</p></div></div>
   </div></div>
</div></body></html>"""

NO_BODY = "<html><body><a class='title'>x</a><time title='t'>t</time></body></html>"


def test_thread_page_f6(spark):
    pages = spark.createDataFrame(
        [(1, "https://h/r/S/comments/abc/t/", F6), (2, "https://h/r/S/comments/zzz/t/", NO_BODY)],
        "page_id long, url string, html string",
    )
    own = {r.id: r for r in TPG.parse_thread_pages(pages).collect()}
    assert set(own) == {"abc", "k1", "k2"}
    post = own["abc"]
    assert (post.title, post.user, post.upvotes, post.date, post.tag, post.author_tag, post.subreddit) == (
        "Post title", "op", 42, "T0", "Meta", "OP flair", "S")
    assert post.text == '<div class="md"><p>post body</p></div>'
    k1, k2 = own["k1"], own["k2"]
    assert (k1.user, k1.upvotes, k1.author_tag, k1.parent_id, k1.date) == (TPG.NO_USER, None, "", "abc", "T1")
    assert k1.url == "https://old.reddit.com/r/S/comments/abc/t/k1/"
    assert (k2.user, k2.upvotes, k2.author_tag, k2.parent_id) == ("replier", -3, "F", "k1")
    assert k2.text == '<div class="md"><p>reply</p></div>'
    sub = {r.id: r for r in TPG.parse_thread_pages(pages, scope="subtree").collect()}
    assert sub["k1"].user == "replier" and sub["k1"].author_tag == "F"  # selectors see the replies too


F6_MARKUP = """<html><body><div class="side"><a class="author">sidebarmod</a></div>
<div class="top-matter"><p class="title"><a class="title" href="/x">Is <b>this <i>real</i></b>&#8212;yes</a>
<span class="flairrichtext flaircolorlight linkflairlabel"><span class="emoji">:x:</span> News</span></p>
<p class="tagline">by <b><a class="author">o<i>p</i></a></b><span class="flair"><span>in</span>ner</span></p></div>
<span class="score unvoted"><b>7</b> points</span><time title="T0">t</time>
<div id="thing_t3_abc"><form id="form-t3_abc"><div class="md"><div class="md">a</div>b</div></form></div>
<div id="siteTable_t3_abc">
 <div data-type="comment" data-fullname="t1_k1"><div class="tagline"><time title="T1">t</time></div>
  <div class="md"><p>c1 body</p><div class="md">quoted</div> tail &amp; end</div>
  <div class="usertext-edit viewSource"><div><textarea>src &lt;1&gt;</textarea></div> x</div></div>
</div></body></html>"""


def test_thread_page_nested_markup(spark):
    pages = spark.createDataFrame([(1, "https://h/r/S/comments/abc/t/", F6_MARKUP)], "page_id long, url string, html string")
    for scope in ("own", "subtree"):
        rows = {r.id: r for r in TPG.parse_thread_pages(pages, scope=scope).collect()}
        post, k1 = rows["abc"], rows["k1"]
        assert (post.title, post.user, post.tag, post.author_tag, post.upvotes) == ("Is this real—yes", "op", ":x: News", "inner", 7)
        assert post.text == '<form id="form-t3_abc"><div class="md"><div class="md">a</div>b</div></form>'
        assert k1.text == '<div class="md"><p>c1 body</p><div class="md">quoted</div> tail &amp; end</div>'
        assert (k1.source_text, k1.user, k1.date) == ("src <1> x", TPG.NO_USER, "T1")


def test_thread_pages_plans_stay_linear(spark):
    """no window frame that shrinks row by row (each row's is computed anew), and a page's bytes are laid out once."""
    pages = spark.createDataFrame([(1, "https://h/r/S/comments/abc/t/", F6)], "page_id long, url string, html string")
    for scope in ("own", "subtree"):
        plan = TPG.parse_thread_pages(pages, scope=scope)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "unboundedfollowing" not in plan
        assert plan.count("regexp_extract_all(") == 1


def test_subtree_page_of_many_replies(spark):
    """only the last of many replies has an author: every comment above it takes that one, in time of the page's length."""
    n = 1500
    html = "<div id='thing_t3_abc'><div class='md'>x</div></div>" + "".join(
        f"<div data-type='comment' data-fullname='t1_k{i}'><div class='md'><p>b{i}</p></div></div>" for i in range(n)
    )
    html += "<div data-type='comment' data-fullname='t1_top'><div data-type='comment' data-fullname='t1_end'><a class='author'>late</a></div></div>"
    pages = spark.createDataFrame([(1, "https://h/r/S/comments/abc/t/", html)], "page_id long, url string, html string")
    rows = {r.id: r for r in TPG.parse_thread_pages(pages, scope="subtree").collect()}
    assert len(rows) == n + 3
    assert rows["top"].user == rows["end"].user == "late" and rows["k7"].user == TPG.NO_USER
    assert rows["k1499"].text == "<div class='md'><p>b1499</p></div>"


def test_render_parse_roundtrip(spark):
    from threadspark.plans import views as V

    u = V.forest_units_for_pages(spark, "/root/testdata/sf0.001")
    back = TPG.parse_thread_pages(TPG.render_thread_pages(u))
    expected = u.withColumn("user", F.coalesce("user", F.lit(TPG.NO_USER))).withColumn("text", F.concat(F.lit('<div class="md">'), F.col("text"), F.lit("</div>")))
    assert back.exceptAll(expected).count() == 0 and expected.exceptAll(back).count() == 0


def test_fragments_join_to_the_documents(spark):
    """Row fragments against documents built by recursion: bushes, a line, single posts, an orphan, order by another column."""
    import random

    from threadspark.schemas import CONTENT_SCHEMA

    rnd = random.Random(6)
    rows, ids = [], []
    for k in range(160):
        post = k % 40 == 0 or k > 150
        parent = None if post else (ids[-1] if k % 40 > 30 else rnd.choice(ids[k // 40 * 40 :]))
        ids.append(f"u{rnd.randint(0, 9999):04d}-{k}")
        rows.append(dict(_unit(ids[-1], parent, rnd.choice(["ann", None]), 'q "x" \\ \n é', post, "T" if post else None), upvotes=rnd.randint(0, 3)))
    units = spark.createDataFrame([tuple(r[f.name] for f in CONTENT_SCHEMA.fields) for r in [*rows, _unit("lost", "gone", "x", "t")]], CONTENT_SCHEMA)
    for order in ("id", "upvotes"):
        def build(r):
            kids = sorted((c for c in rows if c["parent_id"] == r["id"] and not c["is_post"]), key=lambda c: (c[order], c["id"]))
            return {**{c: r[c] for c in CONTENT_COLUMNS}, "replies": [build(c) for c in kids]}

        got = {r.id: json.loads(r.json) for r in N.nest_threads(units, order).collect()}
        assert got == {r["id"]: build(r) for r in rows if r["is_post"]}
    assert N.nest_fragments(units).count() == len(rows)
    assert N.nest_threads(units.limit(0)).collect() == []
    tmp = tempfile.mkdtemp(prefix="ts-frag-")
    WR.write_thread_documents(units, f"{tmp}/t", fmt="files")
    back = RD.read_threads(spark, f"{tmp}/t", suffix=".txt").select(*CONTENT_COLUMNS)
    assert back.exceptAll(units).isEmpty() and back.count() == len(rows)


def test_load_keeps_every_reject_with_its_reason(spark):
    bad = _unit("c9", "c8", "x", "<p>n</p>")
    below = _unit("c8", "p9", "x", "<p>b</p>", replies=[bad, None])
    wrong = {**_unit("p9", None, "x", "<p>t</p>", True), "is_post": "perhaps", "replies": [below, 7]}
    docs = [("1", "[1]"), ("2", "{oops"), ("3", None), ("4", json.dumps(_f1())), ("5", json.dumps(wrong)), ("6", "null"),
            ("7", json.dumps({**_unit("p7", None, "x", "t", True), "replies": 5})), ("8", json.dumps({**_unit("p8", None, "x", "t", True), "date": None})), ("9", "{}")]
    loaded = N.load_threads(spark.createDataFrame(docs, "thread string, value string")).collect()
    reasons = {(r.thread, tuple(r.path)): r.reason for r in loaded if r.reason}
    assert reasons == {
        ("1", ()): "not a document", ("2", ()): "not JSON", ("3", ()): "missing document", ("5", ()): "ill-typed is_post",
        ("5", (0,)): "below a rejected unit", ("5", (0, 0)): "below a rejected unit", ("5", (1,)): "not a document",
        ("6", ()): "not a document", ("7", ()): "ill-typed replies", ("8", ()): "missing date", ("9", ()): "missing url",
    }
    assert len(loaded) == len(reasons) + 5  # units and rejects are all that the documents hold
    assert sorted(r.id for r in loaded if r.reason is None) == ["c1", "c2", "c3", "c4", "p1"]


def test_sample_reads_only_the_chosen_files(spark):
    tmp = tempfile.mkdtemp(prefix="ts-sample-")
    for k in range(30):
        with open(f"{tmp}/t [{k}].json", "w") as f:
            json.dump(_unit(f"p{k}", None, "x", "<p>t</p>", True, "T"), f)
    listing = RD.list_files(spark, tmp)
    assert listing.count() == 30 and "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    docs = RD.sampled_thread_files(spark, tmp, 4, seed=3)
    assert len(docs.inputFiles()) == 4 == docs.count()
    assert {r.path for r in docs.collect()} == {r.path for r in RD.sampled_thread_files(spark, tmp, 4, seed=3).collect()}
    assert RD.read_threads(spark, tmp, max_docs=100).count() == 30
    empty = tempfile.mkdtemp(prefix="ts-none-")
    assert RD.read_threads(spark, empty, max_docs=3).collect() == []


NESTED = """<html><body><div class="top-matter"><p class="tagline"><a class="author">op</a></p></div>
<div id="thing_t3_n1"><div class="md">post</div></div><div id="siteTable_t3_n1">
<div data-type="comment" data-fullname="t1_a"><span class="flair">out &amp; <span class="flair">é in</span> 文</span>
 <div class="md">outer é<div data-type="comment" data-fullname="t1_b"><span class="flair">b</span><div class="md"><i>文</i> inner</div></div>tail</div></div>
<div data-type="comment" data-fullname="t1_c"><a class="author">unclosed é <div class="md">c</div></div>
</div></body></html>"""


def test_nested_elements_of_one_kind_have_their_own_text(spark):
    """A comment inside another's body: both bodies and both flairs, by byte offsets over multi-byte text."""
    pages = spark.createDataFrame([(1, "https://h/r/S/comments/n1/t/", "lead <!-- x -->" + NESTED)], "page_id long, url string, html string")
    rows = {r.id: r for r in TPG.parse_thread_pages(pages).collect()}
    assert rows["b"].text == '<div class="md"><i>文</i> inner</div>' and rows["b"].author_tag == "b" and rows["b"].parent_id == "a"
    assert rows["a"].text.startswith('<div class="md">outer é<div data-type') and rows["a"].text.endswith("</div></div>tail</div>")
    assert rows["a"].author_tag == "out & é in 文"
    assert rows["c"].user == "unclosed é" and rows["c"].text == '<div class="md">c</div>'


def test_thread_files_are_read_in_bounded_tasks(spark, tmp_path):
    """a scan packs few small files into a task; the levels of the trees do not have as many tasks as the scan."""
    from threadspark.sources import readers as RD

    for i in range(300):
        (tmp_path / f"t{i}.json").write_text('{"id": "%d"}' % i)
    loaded = RD.load_files(spark, str(tmp_path))
    assert loaded.count() == 300
    assert RD.thread_files(spark, str(tmp_path)).rdd.getNumPartitions() > 8
    assert loaded.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
