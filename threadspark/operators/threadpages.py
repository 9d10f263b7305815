"""Thread pages -> post and comment rows (P8-P10), and the inverse renderer.

A stored thread page is turned into an *element stream*: one row per tag with
its position, name, attributes and the text that follows it. Everything else
is window functions over that stream, partitioned by page:

* nesting level per element name = running sum of opens minus closes;
  an element ends at the next tag of the same name and level (``lead``);
* a comment is a ``div`` with ``data-type="comment"``; its depth is the running
  count of open comments, its parent is the last comment opened before it at
  depth - 1, and the owner of any tag is the last comment opened before it at
  (open comments - 1). Both are *as-of* lookups (union of openers and queries,
  then ``last(..., ignorenulls)`` over the page order), so no comment x comment
  or element x tag pairs are formed;
* an element is a span: running sums of byte lengths say where its markup and its text begin and
  end in the page's tags and in the page's text, each laid end to end. Only the spans of the elements
  chosen as fields are cut out, by offset, when the rows are complete;
* fields are the first matching element in the comment's own tags
  (``scope='own'``, default) or anywhere in its sub-tree (``scope='subtree'``,
  which is how the original selectors behaved);
* comments without ``data-fullname`` are dropped with their sub-trees, and a
  page without a post body yields no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadspark.functions.html import ATTRS, NOISE_RE, decode_entities, strip
from threadspark.functions.text import first_integer, url_community, url_post_id
from threadspark.schemas import CONTENT_COLUMNS
from threadspark.session import materialize

# Constants of the page format.
NO_USER = "User deleted or not found"
SITE = "https://old.reddit.com"
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
ELEMENT_RE = "<" + ATTRS + ">[^<]*"


def _attr(tag: Column, name: str, decode: bool = True) -> Column:
    """Value of attribute ``name`` (null when absent), found with one regex scan:
    the raw value keeps its quotes, so an empty quoted value differs from a missing one."""
    raw = F.regexp_extract(tag, r"""(?is)\s""" + name + r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    quoted = raw.startswith('"') | raw.startswith("'")
    unquoted = F.when(quoted, raw.substr(F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.when(raw != "", decode_entities(unquoted) if decode else unquoted)


def _elements(html: Column) -> Column:
    """Every tag with the text after it."""
    return F.regexp_extract_all(F.regexp_replace(html, NOISE_RE, ""), F.lit(ELEMENT_RE), 0)


def page_bytes(pages: DataFrame) -> DataFrame:
    """``(page_id, markup, words)``: all elements, and all text between tags, laid end to end as bytes, so a span is cut out in time of its own length."""
    held = pages.select("page_id", _elements(F.col("html")).alias("e"))
    text = F.transform("e", lambda e: F.regexp_extract(e, "^<" + ATTRS + ">([^<]*)", 1))
    return held.select("page_id", F.array_join("e", "").cast("binary").alias("markup"), F.array_join(text, "").cast("binary").alias("words"))


def _markup(span: Column) -> Column:
    return F.substring("markup", (span["m0"] + 1).cast("int"), (span["m1"] - span["m0"]).cast("int")).cast("string")


def _words(span: Column) -> Column:
    return strip(decode_entities(F.substring("words", (span["t0"] + 1).cast("int"), (span["t1"] - span["t0"]).cast("int")).cast("string")))


def element_stream(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, tag, name, closing, cls, lvl, fin, span, ...)`` for every tag of every page."""
    # One shuffle of whole pages by page id, before they grow into tags.
    s = pages.repartition("page_id").select("page_id", F.posexplode(_elements(F.col("html"))).alias("pos", "el"))
    tag = F.regexp_extract("el", "^(<" + ATTRS + ">)", 1)
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("page_id", "pos", tag.alias("tag"), F.octet_length("el").alias("el_size"), F.octet_length(tag).alias("tag_size"))
    s = s.select(
        "*",
        F.coalesce(F.sum("el_size").over(before), F.lit(0)).alias("at"),
        F.coalesce(F.sum(F.col("el_size") - F.col("tag_size")).over(before), F.lit(0)).alias("text_at"),
        F.lower(F.regexp_extract("tag", r"^<\s*/?\s*([A-Za-z][A-Za-z0-9-]*)", 1)).alias("name"),
        F.col("tag").rlike(r"^<\s*/").alias("closing"),
        F.col("tag").rlike(r"/\s*>$").alias("selfclosing"),
        F.split(F.trim(F.coalesce(_attr(F.col("tag"), "class", decode=False), F.lit(""))), r"\s+").alias("cls"),
        _attr(F.col("tag"), "id").alias("id_attr"),
    )
    tracked = (F.col("name") != "") & ~F.col("name").isin(VOID) & ~F.col("selfclosing")
    delta = F.when(tracked & ~F.col("closing"), 1).when(tracked & F.col("closing"), -1).otherwise(0)
    run = F.sum(delta).over(Window.partitionBy("page_id", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("lvl", F.when(tracked & ~F.col("closing"), run).when(tracked & F.col("closing"), run + 1))
    same = Window.partitionBy("page_id", "name", "lvl").orderBy("pos")
    end = F.lead(F.struct("pos", (F.col("at") + F.col("tag_size")).alias("markup"), F.col("text_at").alias("text"))).over(same)
    s = s.withColumn("_end", F.when(F.col("lvl").isNotNull() & ~F.col("closing"), end))
    # an unclosed element is its own tag and the text after it
    span = F.struct(
        F.col("at").alias("m0"), F.coalesce(F.col("_end.markup"), F.col("at") + F.col("el_size")).alias("m1"),
        F.col("text_at").alias("t0"), F.coalesce(F.col("_end.text"), F.col("text_at") + F.col("el_size") - F.col("tag_size")).alias("t1"),
    )
    return s.withColumn("fin", F.col("_end.pos")).withColumn("span", span).drop("_end", "el_size", "tag_size", "at", "text_at")


def _has(*classes: str) -> Column:
    return F.forall(F.array(*[F.lit(c) for c in classes]), lambda c: F.array_contains(F.col("cls"), c))


def _asof_last(openers: DataFrame, queries: DataFrame, value: str) -> DataFrame:
    """For each query ``(page_id, key, pos, qid)`` the ``value`` of the last opener
    ``(page_id, key, pos, value)`` with the same key at a smaller position."""
    o = openers.select("page_id", "key", "pos", F.col(value).alias("_val"), F.lit(None).cast("long").alias("qid"))
    q = queries.select("page_id", "key", "pos", F.lit(None).alias("_val"), "qid")
    u = o.unionByName(q, allowMissingColumns=True)
    w = Window.partitionBy("page_id", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return u.withColumn("found", F.last("_val", ignorenulls=True).over(w)).where(F.col("qid").isNotNull()).select(
        "page_id", "qid", "found"
    )


def _inside(cond: Column) -> Column:
    """(end, start) of the outermost element with ``cond`` open at this tag (its own tags included), else null.

    Elements nest, so among those opened so far the outermost open one has the largest end.
    """
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.coalesce(F.col("fin"), F.col("pos") + 1)  # an unclosed element is its own tag and the text after it
    span = F.max(F.when(cond & ~F.col("closing"), F.struct(end.alias("fin"), F.col("pos").alias("start")))).over(w)
    return F.when(span["fin"] >= F.col("pos"), span)


def parse_thread_pages(pages: DataFrame, scope: str = "own", site: str = SITE) -> DataFrame:
    """Content rows (post + comments) of every stored thread page ``(page_id, url, html)``."""
    if scope not in ("own", "subtree"):
        raise ValueError("scope must be 'own' or 'subtree'")
    # Plain tags (of paragraphs, mostly) end elements, which the stream has settled; what follows looks only at these.
    telling = F.col("name").isin("div", "time") | F.col("id_attr").isNotNull() | (F.col("cls") != F.array(F.lit("")))
    s = materialize(element_stream(pages).where(telling))
    page_order = Window.partitionBy("page_id").orderBy("pos")
    is_div = (F.col("name") == "div") & F.col("lvl").isNotNull()
    is_copen = is_div & ~F.col("closing") & (F.lower(F.coalesce(_attr(F.col("tag"), "data-type", decode=False), F.lit(""))) == "comment")
    s = s.withColumn("copen", is_copen).withColumn("fullname", F.when(is_copen, _attr(F.col("tag"), "data-fullname")))
    opener = Window.partitionBy("page_id", "name", "lvl").orderBy("pos")
    s = s.withColumn("cclose", F.col("closing") & F.coalesce(F.lag("copen").over(opener), F.lit(False)) & is_div)
    s = s.withColumn(
        "bclose", F.col("cclose") & F.lag(F.col("copen") & F.coalesce(F.col("fullname"), F.lit("")).isin("")).over(opener)
    )
    cd = F.sum(F.when(F.col("copen"), 1).when(F.col("cclose"), -1).otherwise(0)).over(
        page_order.rowsBetween(Window.unboundedPreceding, 0)
    )
    bad_open = F.col("copen") & (F.coalesce(F.col("fullname"), F.lit("")) == "")
    bd = F.sum(F.when(bad_open, 1).when(F.col("bclose"), -1).otherwise(0)).over(
        page_order.rowsBetween(Window.unboundedPreceding, 0)
    )
    s = s.withColumn("open_c", cd).withColumn("open_bad", bd)

    m_title = (F.col("name") == "a") & _has("title")
    m_author = (F.col("name") == "a") & _has("author")
    m_score = (F.col("name") == "span") & _has("score", "unvoted")
    m_time = (F.col("name") == "time") & _attr(F.col("tag"), "title").isNotNull()
    m_flair = (F.col("name") == "span") & _has("flair")
    m_label = _has("linkflairlabel") & ~F.col("closing")
    m_source = _has("usertext-edit", "viewSource") & ~F.col("closing")
    closed = ~F.col("closing") & F.col("fin").isNotNull()
    m_md = (F.col("name") == "div") & _has("md") & closed
    m_body = _has("usertext", "warn-on-unload") & closed
    m_form = F.coalesce(F.col("id_attr").startswith("form-t3_"), F.lit(False)) & closed
    # the page's first top-matter element and first post element, and whether a tag lies inside them
    first_so_far = page_order.rowsBetween(Window.unboundedPreceding, -1)

    def in_first(cond: Column) -> Column:
        return F.coalesce(F.first(F.when(cond & closed, F.col("fin")), ignorenulls=True).over(first_so_far) > F.col("pos"), F.lit(False))

    s = s.withColumn("in_top", in_first(_has("top-matter"))).withColumn(
        "in_thing", in_first(F.coalesce(F.col("id_attr").startswith("thing_t3_"), F.lit(False)))
    ).withColumn("in_tagline", _inside(_has("tagline")).isNotNull())
    s = materialize(s)

    comments = s.where("copen").select(
        "page_id", "pos", "fin", "fullname", (F.col("open_c") - 1).alias("depth"),
        (F.col("open_bad") - F.when(F.coalesce(F.col("fullname"), F.lit("")) == "", 1).otherwise(0)).alias("bad_above"),
        _attr(F.col("tag"), "data-permalink").alias("permalink"),
    )
    # parent: last comment opened before at depth - 1
    parents = _asof_last(
        comments.select("page_id", F.col("depth").alias("key"), "pos", "fullname"),
        comments.where(F.col("depth") > 0).select("page_id", (F.col("depth") - 1).alias("key"), "pos", F.col("pos").alias("qid")),
        "fullname",
    ).withColumnRenamed("found", "parent_fullname").withColumnRenamed("qid", "pos")
    # owner of every other tag: last comment opened before at (open comments - 1)
    others = s.where(~F.col("copen") & ~F.col("cclose") & (F.col("open_c") > 0))
    owners = _asof_last(
        comments.select("page_id", F.col("depth").alias("key"), "pos", F.col("pos").alias("cpos")),
        others.select("page_id", (F.col("open_c") - 1).alias("key"), "pos", F.col("pos").alias("qid")),
        "cpos",
    ).select("page_id", F.col("qid").alias("pos"), F.col("found").alias("owner"))
    tags = s.join(owners, ["page_id", "pos"], "left")

    def first(cond: Column, val: Column) -> Column:
        return F.min_by(F.when(cond, val), F.when(cond, F.col("pos")))

    span = F.col("span")
    if scope == "own":
        own = tags.where(F.col("owner").isNotNull()).groupBy("page_id", "owner").agg(
            first(m_author, span).alias("c_user"),
            first(m_score, span).alias("c_score"),
            first(m_time, _attr(F.col("tag"), "title")).alias("c_date"),
            first(m_flair, span).alias("c_flair"),
            first(m_source, span).alias("src_text"),
            first(m_md, span).alias("md_html"),
        )
    else:
        # the first match from here on is the last one of the pages read backwards: a frame that only grows
        # is kept as rows come, one that shrinks is computed anew for every row
        after = Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)

        def nxt(cond: Column, val: Column) -> Column:
            return F.last(F.when(cond, F.struct(F.col("pos").alias("p"), val.alias("v"))), ignorenulls=True).over(after)

        sub = s.select(
            "page_id", "pos", "fin", "copen",
            nxt(m_author, span).alias("n_user"), nxt(m_score, span).alias("n_score"),
            nxt(m_time, _attr(F.col("tag"), "title")).alias("n_date"), nxt(m_flair, span).alias("n_flair"),
            nxt(m_source, span).alias("n_src"), nxt(m_md, span).alias("n_md"),
        ).where("copen")

        def inside(c: str) -> Column:
            return F.when(F.col(f"{c}.p") < F.col("fin"), F.col(f"{c}.v"))

        own = sub.select(
            "page_id", F.col("pos").alias("owner"), inside("n_user").alias("c_user"), inside("n_score").alias("c_score"),
            inside("n_date").alias("c_date"), inside("n_flair").alias("c_flair"), inside("n_src").alias("src_text"),
            inside("n_md").alias("md_html"),
        )

    # ---- comment rows
    own = own.withColumnRenamed("page_id", "_op")
    c = comments.join(parents, ["page_id", "pos"], "left")
    c = c.join(own, (F.col("page_id") == F.col("_op")) & (F.col("pos") == F.col("owner")), "left").drop("_op")
    c = c.where((F.coalesce(F.col("fullname"), F.lit("")) != "") & (F.col("bad_above") == 0))

    # ---- post fields: first match anywhere on the page
    post = s.groupBy("page_id").agg(
        first(m_title, span).alias("title"),
        first(m_author & F.col("in_tagline"), span).alias("p_user"),
        first(m_time, _attr(F.col("tag"), "title")).alias("date"),
        first(m_score, span).alias("p_score"),
        first(m_source, span).alias("src_text"),
        F.coalesce(first(m_body, span), first(m_form, span), first(m_md & F.col("in_thing"), span)).alias("body_html"),
        first(F.col("in_top") & m_label & _has("flairrichtext", "flaircolorlight"), span).alias("t1"),
        first(F.col("in_top") & m_label & _has("flairrichtext", "flaircolorlight", "res-flairSearch"), span).alias("t2"),
        first(F.col("in_top") & m_label, span).alias("t3"),
        first(F.col("in_top") & m_flair, span).alias("p_flair"),
    )
    post = post.where(F.col("body_html").isNotNull()).withColumn("is_post", F.lit(True)).withColumnsRenamed(
        {"p_user": "user", "p_score": "score", "p_flair": "flair"}
    )
    # comments of pages with a post body; a page id held twice counts as often as its pages
    kept_pages = post.select("page_id").join(pages.select("page_id"), "page_id")
    c = c.join(kept_pages, "page_id").select(
        "page_id", "fullname", "permalink", "parent_fullname", F.col("c_user").alias("user"), F.col("c_score").alias("score"), F.col("c_date").alias("date"),
        F.col("c_flair").alias("flair"), "src_text", F.col("md_html").alias("body_html"), F.lit(False).alias("is_post"),
    )
    # all spans of a page meet its bytes at once, in one row, so the bytes are not copied for every comment
    rows = post.unionByName(c, allowMissingColumns=True)
    plain = ["is_post", "fullname", "permalink", "parent_fullname", "date"]
    texts = ["title", "user", "score", "src_text", "t1", "t2", "t3", "flair"]
    spans = rows.groupBy("page_id").agg(F.collect_list(F.struct(*plain, *texts, "body_html")).alias("rows"))

    def cut(r: Column) -> Column:
        return F.struct(*[r[f].alias(f) for f in plain], *[_words(r[f]).alias(f) for f in texts], _markup(r["body_html"]).alias("body_html"))

    rows = spans.join(page_bytes(pages), "page_id").select("page_id", F.inline(F.transform("rows", cut)))
    rows = rows.join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    is_post = F.col("is_post")
    post_id = F.replace(url_post_id(F.col("page_url")), F.lit("t1_"), F.lit(""))
    comment_id, above = (F.replace(F.col(f), F.lit("t1_"), F.lit("")) for f in ("fullname", "parent_fullname"))
    return rows.select(
        F.when(is_post, F.col("page_url")).otherwise(F.concat(F.lit(site), F.coalesce(F.col("permalink"), F.lit("None")))).alias("url"),
        F.when(is_post, F.coalesce(F.col("src_text"), F.lit(""))).otherwise(F.col("src_text")).alias("source_text"),
        url_community(F.col("page_url")).alias("subreddit"),
        F.coalesce(F.col("flair"), F.lit("")).alias("author_tag"),
        F.coalesce(F.col("t1"), F.col("t2"), F.col("t3")).alias("tag"),
        F.coalesce(F.col("user"), F.lit(NO_USER)).alias("user"),
        F.col("body_html").alias("text"),
        F.col("date"),
        first_integer(F.col("score")).alias("upvotes"),
        F.when(is_post, post_id).otherwise(comment_id).alias("id"),
        F.when(~is_post, F.coalesce(above, post_id)).alias("parent_id"),
        is_post.alias("is_post"),
        F.col("title"),
    ).select(*CONTENT_COLUMNS)


# ------------------------------------------------------------------ renderer (inverse, for tests and round trips)


def _esc(c: Column) -> Column:
    c = F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def render_thread_pages(units: DataFrame, site: str = SITE) -> DataFrame:
    """Render content units as thread pages ``(page_id, url, html)`` (one page per post).

    Comment permalinks are the path of the comment's ``url`` after the site;
    ``text`` is placed inside ``<div class="md">``.
    """
    from threadspark.operators.threads import reach

    nodes = reach(units).nodes.select(F.col("id").alias("_pid_"), "depth", "root")
    u = materialize(units.join(nodes, units["id"] == F.col("_pid_")).drop("_pid_"))  # read once per level
    max_d = u.agg(F.max("depth")).first()[0]
    if max_d is None:
        return units.sparkSession.createDataFrame([], "page_id string, url string, html string")
    tagline = F.concat(
        F.lit('<p class="tagline">'),
        F.when(F.col("user").isNotNull(), F.concat(F.lit('<a class="author" href="/user/'), _esc(F.col("user")), F.lit('">'), _esc(F.col("user")), F.lit("</a>"))).otherwise(F.lit("")),
        F.when(F.col("upvotes").isNotNull(), F.concat(F.lit('<span class="score unvoted">'), F.col("upvotes").cast("string"), F.lit(" points</span>"))).otherwise(F.lit("")),
        F.when(F.col("date").isNotNull(), F.concat(F.lit('<time title="'), _esc(F.col("date")), F.lit('">'), _esc(F.col("date")), F.lit("</time>"))).otherwise(F.lit("")),
        F.when(F.coalesce(F.col("author_tag"), F.lit("")) != "", F.concat(F.lit('<span class="flair">'), _esc(F.col("author_tag")), F.lit("</span>"))).otherwise(F.lit("")),
        F.lit("</p>"),
    )
    below = None
    for d in range(max_d, -1, -1):
        lvl = u.where(F.col("depth") == d)
        if below is not None:
            lvl = lvl.join(below, lvl["id"] == below["_kpid"], "left").drop("_kpid")
        else:
            lvl = lvl.withColumn("_kids", F.lit(None).cast("string"))
        kids = F.coalesce(F.col("_kids"), F.lit(""))
        if d > 0:
            permalink = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "^" + site.replace(".", r"\."), "")
            html = F.concat(
                F.lit('<div class="thing comment" data-type="comment" data-fullname="t1_'), _esc(F.col("id")),
                F.lit('" data-permalink="'), _esc(permalink), F.lit('">'), tagline,
                F.lit('<div class="md">'), F.coalesce(F.col("text"), F.lit("")), F.lit("</div>"),
                F.lit('<div id="siteTable_t1_'), _esc(F.col("id")), F.lit('">'), kids, F.lit("</div></div>"),
            )
            lvl = materialize(lvl.select("id", "parent_id", html.alias("html")))
            below = lvl.groupBy(F.col("parent_id").alias("_kpid")).agg(
                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id"), F.col("html")))), lambda s: s["html"]), "").alias("_kids")
            )
        else:
            html = F.concat(
                F.lit("<html><head><title>"), _esc(F.col("title")), F.lit("</title></head><body>"),
                F.lit('<div class="top-matter"><p class="title"><a class="title" href="'), _esc(F.col("url")), F.lit('">'),
                _esc(F.col("title")), F.lit("</a></p>"), tagline, F.lit("</div>"),
                F.lit('<div id="thing_t3_'), _esc(F.col("id")), F.lit('"><div class="md">'), F.coalesce(F.col("text"), F.lit("")),
                F.lit("</div></div>"),
                F.lit('<div id="siteTable_t3_'), _esc(F.col("id")), F.lit('">'), kids, F.lit("</div></body></html>"),
            )
            return lvl.select(F.col("id").alias("page_id"), "url", html.alias("html"))
    raise AssertionError("unreachable")
