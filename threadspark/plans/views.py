"""Content tables derived from the driver tables, defined identically for Spark and DuckDB.

* ``forest``  (V1): branching threads over ``documents``; 40 documents per thread,
  fan-out 3, four levels.
* ``conv``    (V2): ``conversations`` as linear threads (each turn replies to the previous one).
* ``page_units`` (V3): ``pages`` as units (even page ids are posts titled by ``<title>``).
* ``trials``  (V4): a trial-log stand-in from ``lineitem`` (one row per supplier).

Plain text is wrapped as one ``<p>`` per line, so the HTML operators apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadspark.functions.html import html_title, wrap_paragraphs
from threadspark.plans import duck as D
from threadspark.schemas import CONTENT_COLUMNS

# Shape of the derived forest; which comments get a missing parent in the orphan variant.
THREAD_SIZE = 40
FANOUT = 3
ORPHAN_MOD, ORPHAN_REM = 97, 5

# Paragraphs put before the pages' own markup (nested elements, links, emphasis, character references).
MARKUP = [
    "<p>a <span>b<span>c</span>d</span> e</p>",
    "<p>one &mdash; two&hellip; it&#8217;s &#x2014; &amp;lt; &copy 3 &nosuch; &</p>",
    '<p>see <a href="/q?a=1&amp;b=2">the <b>big</b> <span>no</span> page</a>, <em>very <span>x</span>good</em></p>',
    "<p>before<div>in <span>deep <div>er</div></span></div>after <div class='x'><em>gone</em></div> end</p>",
    "<p>x <SPAN title=\"a > b\">y</SPAN> z</p><p>   </p>",
]
# The listing put before a page's own markup; None stands for the page id, 0 for a count of 40 to 59.
LISTING = [
    '<div id="side"><a href="https://h/r/S/comments/side/t/">99 comments</a></div><div class="x" id="siteTable">'
    '<div><div><a href="https://h/r/S/comments/p', None, '/t/">', 0, " comments</a></div>"
    '<a href="https://h/r/S/comments/q', None, '/t/">1,2', 0, " <b>comments</b></a></div>"
    '<a href="https://h/r/S/comments/can/t/">60 comments Can</a><a href="https://h/r/S/comments/word/t/">many comments</a>'
    '<a href="https://h/r/S/other/">70 comments</a><a>80 comments</a></div>'
    '<div><a href="https://h/r/S/comments/after/t/">77 comments</a></div>',
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _content(df: DataFrame, **cols) -> DataFrame:
    defaults = {
        "url": F.lit(None).cast("string"),
        "source_text": F.lit(None).cast("string"),
        "subreddit": F.lit(None).cast("string"),
        "author_tag": F.lit(None).cast("string"),
        "tag": F.lit(None).cast("string"),
        "date": F.lit(None).cast("string"),
        "upvotes": F.lit(None).cast("bigint"),
    }
    defaults.update(cols)
    return df.select(*[defaults[c].alias(c) for c in CONTENT_COLUMNS])


def forest(spark: SparkSession, sf_dir: str, broken_parents: bool = False) -> DataFrame:
    """V1. With ``broken_parents`` every row is kept, but the comments whose doc_id is
    ORPHAN_REM mod ORPHAN_MOD point to a parent id that does not exist (orphans)."""
    d = table(spark, sf_dir, "documents")
    local = F.col("doc_id") % THREAD_SIZE
    parent = F.col("doc_id") - local + F.floor((local - 1) / FANOUT).cast("bigint")
    parent_id = parent.cast("string")
    if broken_parents:
        parent_id = F.when(F.col("doc_id") % ORPHAN_MOD == ORPHAN_REM, F.concat(F.lit("missing-"), parent_id)).otherwise(parent_id)
    return _content(
        d,
        url=F.concat(F.lit("doc:"), F.col("doc_id").cast("string")),
        subreddit=F.col("lang"),
        user=F.col("source"),
        text=wrap_paragraphs(F.col("text")),
        date=F.lit(""),
        id=F.col("doc_id").cast("string"),
        parent_id=F.when(local != 0, parent_id),
        is_post=local == 0,
        title=F.when(local == 0, F.concat(F.lit("thread "), F.col("doc_id").cast("string"))),
    )


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    cid = F.col("conv_id").cast("string")
    return _content(
        c,
        url=F.concat(F.lit("conv:"), cid),
        user=F.col("role"),
        text=wrap_paragraphs(F.col("text")),
        date=F.lit(""),
        id=F.concat(cid, F.lit("-"), F.col("turn").cast("string")),
        parent_id=F.when(F.col("turn") > 0, F.concat(cid, F.lit("-"), (F.col("turn") - 1).cast("string"))),
        is_post=F.col("turn") == 0,
        title=F.when(F.col("turn") == 0, F.concat(F.lit("conversation "), cid)),
    )


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with one of the MARKUP paragraphs (by page id) before its own markup."""
    extra = F.element_at(F.array(*[F.lit(m) for m in MARKUP]), (F.col("page_id") % len(MARKUP) + 1).cast("int"))
    return table(spark, sf_dir, "pages").withColumn("html", F.concat(extra, F.col("html")))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a listing: links before, inside and after its ``#siteTable``, with counts around 50."""
    pid = F.col("page_id").cast("string")
    parts = [pid if x is None else (40 + F.col("page_id") % 20).cast("string") if x == 0 else F.lit(x) for x in LISTING]
    return table(spark, sf_dir, "pages").withColumn("html", F.concat(*parts, F.col("html")))


def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = marked_pages(spark, sf_dir)
    is_post = F.col("page_id") % 2 == 0
    return _content(
        p,
        url=F.col("url"),
        text=F.col("html"),
        date=F.lit(""),
        id=F.col("page_id").cast("string"),
        parent_id=F.lit(None).cast("string"),
        is_post=is_post,
        title=F.when(is_post, html_title(F.col("html"))),
        user=F.lit(None).cast("string"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("trial_id")).agg(
        F.round(F.avg("l_discount"), 6).alias("avg_topic_coherence"),
        F.round(-F.avg("l_tax") * 100, 6).alias("perplexity"),
        F.round(F.countDistinct("l_returnflag") / F.lit(3.0), 6).alias("diversity"),
        F.when(F.col("trial_id") % 10 == 0, F.lit(None)).otherwise(F.round(F.avg("l_quantity"), 6)).alias("avg_entropy"),
        F.round(F.max("l_discount"), 6).alias("stability_score"),
        F.round(F.sum("l_quantity"), 6).alias("model_training_time"),
    )


# ---------------------------------------------------------------- DuckDB side

_NULLS = {
    "url": None,
    "source_text": "CAST(NULL AS VARCHAR)",
    "subreddit": "CAST(NULL AS VARCHAR)",
    "author_tag": "CAST(NULL AS VARCHAR)",
    "tag": "CAST(NULL AS VARCHAR)",
    "date": None,
    "upvotes": "CAST(NULL AS BIGINT)",
}


def _duck_content(src: str, **cols: str) -> str:
    merged = dict(_NULLS)
    merged.update(cols)
    return "SELECT " + ", ".join(f'{merged[c]} AS "{c}"' for c in CONTENT_COLUMNS) + f" FROM {src}"


def duck_forest(broken_parents: bool = False) -> str:
    src = "documents"
    local = f"(doc_id % {THREAD_SIZE})"
    parent = f"CAST(doc_id - {local} + CAST(floor(({local} - 1) / {FANOUT}) AS BIGINT) AS VARCHAR)"
    if broken_parents:
        parent = f"CASE WHEN doc_id % {ORPHAN_MOD} = {ORPHAN_REM} THEN 'missing-' || {parent} ELSE {parent} END"
    return _duck_content(
        src,
        url="'doc:' || CAST(doc_id AS VARCHAR)",
        subreddit="lang",
        user="source",
        text=D.wrap_paragraphs("text"),
        date="''",
        id="CAST(doc_id AS VARCHAR)",
        parent_id=f"CASE WHEN {local} <> 0 THEN {parent} END",
        is_post=f"{local} = 0",
        title=f"CASE WHEN {local} = 0 THEN 'thread ' || CAST(doc_id AS VARCHAR) END",
    )


def duck_conv() -> str:
    cid = "CAST(conv_id AS VARCHAR)"
    return _duck_content(
        "conversations",
        url=f"'conv:' || {cid}",
        user="role",
        text=D.wrap_paragraphs("text"),
        date="''",
        id=f"{cid} || '-' || CAST(turn AS VARCHAR)",
        parent_id=f"CASE WHEN turn > 0 THEN {cid} || '-' || CAST(turn - 1 AS VARCHAR) END",
        is_post="turn = 0",
        title=f"CASE WHEN turn = 0 THEN 'conversation ' || {cid} END",
    )


def duck_marked_pages() -> str:
    extra = ", ".join(D.q(m) for m in MARKUP)
    return f"(SELECT page_id, url, ([{extra}])[page_id % {len(MARKUP)} + 1] || html AS html FROM pages)"


def duck_page_units() -> str:
    is_post = "page_id % 2 = 0"
    return _duck_content(
        duck_marked_pages(),
        url="url",
        text="html",
        date="''",
        id="CAST(page_id AS VARCHAR)",
        parent_id="CAST(NULL AS VARCHAR)",
        is_post=is_post,
        title=f"CASE WHEN {is_post} THEN {D.html_title('html')} END",
        user="CAST(NULL AS VARCHAR)",
    )


DUCK_TRIALS = """SELECT l_suppkey AS trial_id,
  round(avg(l_discount), 6) AS avg_topic_coherence,
  round(-avg(l_tax) * 100, 6) AS perplexity,
  round(count(DISTINCT l_returnflag) / 3.0, 6) AS diversity,
  CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE round(avg(l_quantity), 6) END AS avg_entropy,
  round(max(l_discount), 6) AS stability_score,
  round(sum(l_quantity), 6) AS model_training_time
FROM lineitem GROUP BY l_suppkey"""


# ---------------------------------------------------------------- V6: forest as thread pages
from threadspark.operators.threadpages import SITE  # noqa: E402


# An md element inside a body, and what follows it.
INNER_MD = ['<div class="md">', "</div><p>after &amp; <div>more</div></p>"]
NO_USER = "User deleted or not found"


def forest_units_for_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest with the fields a thread page carries; by id, comments lack an author or votes, units carry a
    flair, and bodies hold an ``md`` element of their own."""
    d = table(spark, sf_dir, "documents")
    local = F.col("doc_id") % THREAD_SIZE
    root = (F.col("doc_id") - local).cast("string")
    parent = F.col("doc_id") - local + F.floor((local - 1) / FANOUT).cast("bigint")
    sid = F.col("doc_id").cast("string")
    url = F.when(local == 0, F.concat(F.lit(SITE + "/r/forest/comments/"), sid, F.lit("/thread/"))).otherwise(
        F.concat(F.lit(SITE + "/r/forest/comments/"), root, F.lit("/thread/"), sid, F.lit("/"))
    )
    return _content(
        d,
        url=url,
        source_text=F.when(local == 0, F.lit("")),
        subreddit=F.lit("forest"),
        author_tag=F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("flair & "), (F.col("doc_id") % 5).cast("string"))).otherwise(""),
        user=F.when((local == 0) | (F.col("doc_id") % 7 != 3), F.col("source")),
        text=F.when(
            F.col("doc_id") % 5 == 2, F.concat(F.lit(INNER_MD[0]), wrap_paragraphs(F.col("text")), F.lit(INNER_MD[1]))
        ).otherwise(wrap_paragraphs(F.col("text"))),
        date=F.concat(F.lit("d"), sid),
        upvotes=F.when((local == 0) | (F.col("doc_id") % 11 != 5), (F.col("doc_id") % 50 - 10).cast("bigint")),
        id=sid,
        parent_id=F.when(local != 0, parent.cast("string")),
        is_post=local == 0,
        title=F.when(local == 0, F.concat(F.lit("thread "), sid)),
    )


def duck_thread_page_rows(scope: str = "own") -> str:
    """Expected parse of the rendered forest pages; with scope 'subtree' a comment's missing fields come from
    the first reply below it, in page order, that has them."""
    local = f"(doc_id % {THREAD_SIZE})"
    sid = "CAST(doc_id AS VARCHAR)"
    root = f"CAST(doc_id - {local} AS VARCHAR)"
    parent = f"CAST(doc_id - {local} + CAST(floor(({local} - 1) / {FANOUT}) AS BIGINT) AS VARCHAR)"
    body = D.wrap_paragraphs("text")
    rows = f"""SELECT *, {sid} AS id, CASE WHEN {local} <> 0 THEN {parent} END AS up,
  CASE WHEN {local} = 0 OR doc_id % 7 <> 3 THEN source END AS own_user,
  CASE WHEN {local} = 0 OR doc_id % 11 <> 5 THEN CAST(doc_id % 50 - 10 AS BIGINT) END AS own_votes,
  CASE WHEN doc_id % 3 = 1 THEN 'flair & ' || (doc_id % 5) END AS own_flair FROM documents"""
    own = _duck_content(
        "fields",
        url=f"CASE WHEN {local} = 0 THEN '{SITE}/r/forest/comments/' || id || '/thread/' "
        f"ELSE '{SITE}/r/forest/comments/' || {root} || '/thread/' || id || '/' END",
        source_text=f"CASE WHEN {local} = 0 THEN '' END",
        subreddit="'forest'",
        author_tag="coalesce(flair, '')",
        user=f"coalesce(author, {D.q(NO_USER)})",
        text=f"'<div class=\"md\">' || CASE WHEN doc_id % 5 = 2 THEN {D.q(INNER_MD[0])} || {body} || {D.q(INNER_MD[1])} ELSE {body} END || '</div>'",
        date="'d' || id",
        upvotes="votes",
        id="id",
        parent_id="up",
        is_post=f"{local} = 0",
        title=f"CASE WHEN {local} = 0 THEN 'thread ' || id END",
    )
    if scope == "own":
        return f"WITH r AS ({rows}), fields AS (SELECT *, own_user AS author, own_votes AS votes, own_flair AS flair FROM r) {own}"
    # paths of ids joined by a character below the digits sort like the page order
    return f"""WITH RECURSIVE r AS ({rows}),
walk AS (SELECT id, id AS path, [id] AS above FROM r WHERE up IS NULL
  UNION ALL SELECT r.id, walk.path || chr(1) || r.id, list_append(walk.above, r.id) FROM r JOIN walk ON r.up = walk.id),
below AS (SELECT id, path, unnest(above) AS holder FROM walk),
found AS (SELECT holder, arg_min(own_user, path) FILTER (own_user IS NOT NULL) AS f_user,
  arg_min(own_votes, path) FILTER (own_votes IS NOT NULL) AS f_votes, arg_min(own_flair, path) FILTER (own_flair IS NOT NULL) AS f_flair
  FROM below JOIN r USING (id) GROUP BY holder),
fields AS (SELECT r.*, coalesce(own_user, f_user) AS author, coalesce(own_votes, f_votes) AS votes,
  CASE WHEN up IS NULL THEN own_flair ELSE f_flair END AS flair FROM r JOIN found ON holder = id) {own}"""
