"""Registered queries over the driver tables and their independent DuckDB oracles.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> SQL``.
Column names and types are aligned between the two sides; every query reads
whole tables (no id subsets or row caps).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadspark.operators import prompts as L
from threadspark.operators import threads as T
from threadspark.plans import views as V
from threadspark.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


# Task template used by the template query (any caller text works).
TEMPLATE = "Rate each message of the exchange below."

# ------------------------------------------------------------------ threads

_CHAIN_COLS = '"url", "source_text", "subreddit", "author_tag", "tag", "user", "text", "date", "upvotes", "id", "parent_id", "is_post", "title"'


def _duck_walk(units_sql: str) -> str:
    return f"""WITH RECURSIVE u AS ({units_sql}),
walk(id, path) AS (
  SELECT id, [id] FROM u WHERE is_post
  UNION ALL
  SELECT c.id, list_append(w.path, c.id) FROM u c JOIN walk w ON c.parent_id = w.id WHERE NOT c.is_post
),
leaf AS (SELECT id FROM u WHERE NOT EXISTS (SELECT 1 FROM u c WHERE c.parent_id = u.id)),
members AS (
  SELECT w.id AS chain_id, CAST(generate_subscripts(w.path, 1) - 1 AS INTEGER) AS chain_rank, unnest(w.path) AS member
  FROM walk w JOIN leaf l ON l.id = w.id
),
counts AS (SELECT parent_id, CAST(count(*) AS INTEGER) AS child_count FROM u WHERE parent_id IS NOT NULL GROUP BY parent_id)"""


def _duck_chain_table(units_sql: str) -> str:
    return (
        _duck_walk(units_sql)
        + f"""
SELECT {', '.join('u.' + c for c in _CHAIN_COLS.split(', '))}, coalesce(k.child_count, 0) AS child_count, m.chain_id, m.chain_rank
FROM members m JOIN u ON u.id = m.member LEFT JOIN counts k ON k.parent_id = u.id"""
    )


@register("chains", _duck_chain_table(V.duck_forest()))
def q_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain table over the branching forest."""
    return T.chain_table(V.forest(spark, sf_dir))


@register("conversation_chains", _duck_chain_table(V.duck_conv()))
def q_conversation_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain table over conversations (linear threads)."""
    return T.chain_table(V.conv(spark, sf_dir))


@register(
    "children_index",
    f"""WITH u AS ({V.duck_forest()})
SELECT parent_id, id AS child_id, CAST(count(*) OVER (PARTITION BY parent_id) AS INTEGER) AS child_count
FROM u WHERE parent_id IS NOT NULL""",
)
def q_children_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children index in long form, with each parent's child count."""
    u = V.forest(spark, sf_dir)
    return T.children_edges(u).join(T.child_counts(u), "parent_id")


@register(
    "leaves",
    f"""WITH u AS ({V.duck_forest()})
SELECT id, is_post FROM u WHERE NOT EXISTS (SELECT 1 FROM u c WHERE c.parent_id = u.id)""",
)
def q_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: leaf units of the forest."""
    return T.leaves(V.forest(spark, sf_dir)).select("id", "is_post")


@register(
    "orphans",
    f"""WITH RECURSIVE u AS ({V.duck_forest(broken_parents=True)}),
walk(id) AS (SELECT id FROM u WHERE is_post UNION ALL SELECT c.id FROM u c JOIN walk w ON c.parent_id = w.id WHERE NOT c.is_post)
SELECT id, parent_id FROM u WHERE id NOT IN (SELECT id FROM walk)""",
)
def q_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units never reached from a post when some comments point to missing parents."""
    return T.rejects(V.forest(spark, sf_dir, broken_parents=True)).select("id", "parent_id")


@register(
    "orphan_chains",
    _duck_walk(V.duck_forest(broken_parents=True))
    + "\nSELECT chain_id, count(*) AS chain_len, CAST(max(chain_rank) AS INTEGER) AS max_rank FROM members GROUP BY chain_id",
)
def q_orphan_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 with broken parent links: chains exist only for leaves reached from a post."""
    m = T.chain_members(V.forest(spark, sf_dir, broken_parents=True))
    return m.groupBy("chain_id").agg(F.count(F.lit(1)).alias("chain_len"), F.max("chain_rank").alias("max_rank"))


# ------------------------------------------------------------------ prompts


def _duck_prompts(units_sql: str) -> str:
    from threadspark.plans import duck as D

    src = D.html_to_source("u.text")
    user = "coalesce(u.\"user\", 'nan')"
    title = "coalesce(u.title, 'nan')"
    line = (
        f"CASE WHEN m.chain_rank = 0 THEN 'Post by ' || {user} || ', title: ' || {title} || ', initial comment: ' || {src} || ' ' || chr(10) "
        f"ELSE 'Responded to by ' || {user} || ', comment: ' || {src} || ' ' || chr(10) END"
    )
    return (
        _duck_walk(units_sql)
        + f""",
lines AS (SELECT m.chain_id, m.member AS id, m.chain_rank, {line} AS line FROM members m JOIN u ON u.id = m.member)
SELECT chain_id, id, chain_rank,
  string_agg(line, '' ORDER BY chain_rank) OVER (PARTITION BY chain_id ORDER BY chain_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prompt
FROM lines"""
    )


@register("chain_prompts", _duck_prompts(V.duck_conv()))
def q_chain_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: chain-prefix prompt for every (chain, unit) of the conversation threads."""
    return L.chain_prompts(V.conv(spark, sf_dir))


@register("forest_prompts", _duck_prompts(V.duck_forest()))
def q_forest_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 on branching threads: shared prefixes are built once per unit."""
    return L.chain_prompts(V.forest(spark, sf_dir))


@register(
    "prompt_template",
    "SELECT chain_id, id, " + f"'{TEMPLATE}' || ' ' || chr(10) || ' ' || prompt AS model_input FROM ("
    + _duck_prompts(V.duck_conv())
    + ")",
)
def q_prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: task template + prompt."""
    return L.apply_template(L.chain_prompts(V.conv(spark, sf_dir)), TEMPLATE).select("chain_id", "id", "model_input")


# ------------------------------------------------------------------ HTML and text
from threadspark.functions import html as H  # noqa: E402
from threadspark.functions import text as X  # noqa: E402
from threadspark.operators import corpus as C  # noqa: E402
from threadspark.operators import lexicon as LX  # noqa: E402
from threadspark.operators import pages as P  # noqa: E402
from threadspark.operators import ranking as R  # noqa: E402
from threadspark.plans import duck as D  # noqa: E402


@register(
    "html_paragraphs",
    f"""SELECT page_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS para_idx, unnest(p) AS paragraph
FROM (SELECT page_id, {D.html_to_paragraphs('html')} AS p FROM {V.duck_marked_pages()})""",
)
def q_html_paragraphs(spark, sf_dir):
    """Every paragraph of every page, in order (empty paragraphs kept)."""
    pages = V.marked_pages(spark, sf_dir)
    return pages.select("page_id", F.posexplode(H.html_to_paragraphs(F.col("html"))).alias("para_idx", "paragraph"))


@register("html_source", f"SELECT page_id, {D.html_to_source('html')} AS source FROM {V.duck_marked_pages()}")
def q_html_source(spark, sf_dir):
    """Page HTML -> source text."""
    return V.marked_pages(spark, sf_dir).select("page_id", H.html_to_source(F.col("html")).alias("source"))


@register("source_cleanup", f"SELECT page_id, {D.clean_source(D.html_to_source('html'))} AS clean FROM pages")
def q_source_cleanup(spark, sf_dir):
    """X3 over X2."""
    return V.table(spark, sf_dir, "pages").select("page_id", H.clean_source(H.html_to_source(F.col("html"))).alias("clean"))


@register(
    "tokens",
    f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS token_text
FROM (SELECT doc_id, {D.tokenize('text')} AS t FROM documents)""",
)
def q_tokens(spark, sf_dir):
    """Word tokens of every document."""
    t = X.tokenize(F.col("text"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("token_text"))


def _duck_lemmas() -> str:
    rules = " UNION ALL ".join(
        f"SELECT form, {i} AS i, substr(form, 1, length(form) - {len(s)}) || '{r}' AS cand FROM words WHERE suffix(form, '{s}')"
        for i, (s, r) in enumerate(LX.NOUN_RULES, start=1)
    )
    return f"""WITH toks AS (
  SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token
  FROM (SELECT doc_id, {D.tokenize('lower(text)')} AS t FROM documents)),
words AS (SELECT DISTINCT token AS form FROM toks),
cands AS ({rules}),
known AS (SELECT c.* FROM cands c WHERE c.cand IN (SELECT form FROM words)),
lex AS (SELECT form, arg_min(cand, length(cand) * 100 + i) AS lemma FROM known GROUP BY form),
lem AS (SELECT t.doc_id, t.pos, coalesce(l.lemma, t.token) AS lemma FROM toks t LEFT JOIN lex l ON l.form = t.token),
agg AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY pos) AS lemma_text FROM lem GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.lemma_text, '') AS lemma_text FROM documents d LEFT JOIN agg a ON a.doc_id = d.doc_id"""


@register("lemmas", _duck_lemmas())
def q_lemmas(spark, sf_dir):
    """Lower-case, tokenise and lemmatise every document (lexicon derived from the corpus)."""
    return LX.lemmatize_text(V.table(spark, sf_dir, "documents"))


_CP1252_HIGH = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"  # fixed values: what cp1252 holds beyond latin-1's printable part


@register(
    "encode_replace",
    f"""SELECT doc_id, regexp_replace(text, '[^\\x{{00}}-\\x{{FF}}]', '?', 'g') AS latin1, regexp_replace(text, '[^\\x{{00}}-\\x{{7F}}\\x{{A0}}-\\x{{FF}}{_CP1252_HIGH}]', '?', 'g') AS cp1252,
  text AS utf8, text AS gb18030, CASE WHEN NOT regexp_matches(text, '[\\x{{80}}-\\x{{FF}}]') THEN regexp_replace(text, '[^\\x{{00}}-\\x{{7F}}]', '?', 'g') END AS mixed FROM documents""",
)
def q_encode_replace(spark, sf_dir):
    """Latin-1, cp1252, utf-8, a multi-byte codec, and latin-1 bytes read as utf-8 (null where they cannot be)."""
    t = F.col("text")
    same = [X.encode_replace(t, c).alias(n) for c, n in (("latin-1", "latin1"), ("cp1252", "cp1252"), ("utf-8", "utf8"), ("gb18030", "gb18030"))]
    return V.table(spark, sf_dir, "documents").select("doc_id", *same, X.encode_replace(t, "latin-1", "utf-8").alias("mixed"))


@register("ascii_replace", f"SELECT doc_id, {D.ascii_replace('text')} AS ascii_text FROM documents")
def q_ascii_replace(spark, sf_dir):
    """Encode to ASCII with '?' replacement."""
    return V.table(spark, sf_dir, "documents").select("doc_id", X.ascii_replace(F.col("text")).alias("ascii_text"))


@register(
    "nonalnum_count",
    f"SELECT doc_id, {D.nonalnum_distinct('text')} AS nonalnum, CAST(length(text) AS INTEGER) AS char_len FROM documents",
)
def q_nonalnum_count(spark, sf_dir):
    """Distinct non-alphanumeric characters and length of every document."""
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.nonalnum_distinct(F.col("text")).alias("nonalnum"), X.char_length(F.col("text")).alias("char_len"))


@register("vote_parse", f"SELECT doc_id, {D.first_integer('text')} AS upvotes FROM documents")
def q_vote_parse(spark, sf_dir):
    """P5: first integer of the text, else null."""
    return V.table(spark, sf_dir, "documents").select("doc_id", X.first_integer(F.col("text")).alias("upvotes"))


@register(
    "prefix_strip",
    "SELECT doc_id, replace('t1_' || CAST(doc_id AS VARCHAR), 't1_', '') AS post_id, "
    "CAST(length(replace(text, 't1_', '')) AS INTEGER) AS stripped_len FROM documents",
)
def q_prefix_strip(spark, sf_dir):
    """Remove every fullname prefix."""
    d = V.table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        X.strip_fullname(F.concat(F.lit("t1_"), F.col("doc_id").cast("string"))).alias("post_id"),
        F.length(X.strip_fullname(F.col("text"))).alias("stripped_len"),
    )


@register("url_keys", f"SELECT page_id, {D.url_post_id('url')} AS post_id, {D.url_community('url')} AS community FROM pages")
def q_url_keys(spark, sf_dir):
    """Post id and community from page URLs."""
    p = V.table(spark, sf_dir, "pages")
    return p.select("page_id", X.url_post_id(F.col("url")).alias("post_id"), X.url_community(F.col("url")).alias("community"))


# ------------------------------------------------------------------ links and work-lists


def _duck_anchors(where: str = "pages") -> str:
    head = f"regexp_extract(tag, {D.q(rf'(?is)^<a{chr(92)}b({D.ATTRS})>')}, 1)"
    href = D.decode(" || ".join(f"regexp_extract({head}, {D.q(D.HREF)}, {i})" for i in (1, 2, 3)))
    inner = f"regexp_extract(tag, {D.q(rf'(?is)^<a{chr(92)}b{D.ATTRS}>(.*?)</a{chr(92)}s*>{chr(92)}z')}, 1)"
    visible = f"regexp_replace({inner}, {D.q(D.ANY_TAG)}, '', 'g')"
    text = D.strip(f"regexp_replace({D.decode(visible)}, {D.q(D.SPACE + '+')}, ' ', 'g')")
    origin = f"regexp_extract(url, {D.q(r'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)')}, 1)"
    scheme = f"regexp_extract(url, {D.q(r'^([A-Za-z][A-Za-z0-9+.-]*):')}, 1)"
    directory = f"regexp_extract(url, {D.q(r'^([^?#]*/)')}, 1)"
    resolved = (
        f"CASE WHEN regexp_matches(h, {D.q(r'^[A-Za-z][A-Za-z0-9+.-]*:')}) THEN h "
        f"WHEN starts_with(h, '//') THEN {scheme} || ':' || h "
        f"WHEN starts_with(h, '/') THEN {origin} || h WHEN h = '' THEN NULL ELSE {directory} || h END"
    )
    return f"""(SELECT page_id, pos, CASE WHEN has_href THEN {resolved} END AS href, text FROM (
  SELECT page_id, url, pos, regexp_matches({head}, {D.q(D.HREF)}) AS has_href, {href} AS h, {text} AS text FROM (
    SELECT page_id, url, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS tag
    FROM (SELECT page_id, url, regexp_extract_all(html, {D.q(D.ANCHOR)}, 0) AS a FROM {where}))))"""


@register("extract_links", "SELECT * FROM " + _duck_anchors())
def q_extract_links(spark, sf_dir):
    """Every anchor of every stored page with resolved href and visible text."""
    return P.anchors(V.table(spark, sf_dir, "pages"))


@register(
    "harvest_post_links",
    """SELECT page_id, k AS pos, 'https://h/r/S/comments/' || post_id || '/t/' AS href, text, post_id FROM (
  SELECT page_id, CAST(0 AS INTEGER) AS k, 'p' || page_id AS post_id, (40 + page_id % 20) || ' comments' AS text FROM pages WHERE page_id % 20 >= 10
  UNION ALL SELECT page_id, 1, 'q' || page_id, '1,2' || (40 + page_id % 20) || ' comments' FROM pages)""",
)
def q_harvest_post_links(spark, sf_dir):
    """Thread links as the listing harvest keeps them (inside the listing, needle 'comments', count >= 50)."""
    return P.harvest_post_links(P.anchors(V.listing_pages(spark, sf_dir), within="siteTable"))


@register(
    "link_upsert",
    f"""SELECT post_id, url FROM (
  SELECT lower(text) AS post_id, href AS url,
    row_number() OVER (PARTITION BY lower(text) ORDER BY page_id % 2 DESC, page_id * 1000000 + pos DESC) AS rn
  FROM {_duck_anchors()} a) WHERE rn = 1""",
)
def q_link_upsert(spark, sf_dir):
    """Link map from even pages, upserted with links from odd pages (key = anchor text)."""
    a = P.anchors(V.table(spark, sf_dir, "pages")).select(
        F.lower("text").alias("post_id"), F.col("href").alias("url"), (F.col("page_id") * 1000000 + F.col("pos")).alias("seq"), "page_id"
    )
    return P.upsert_links(a.where(F.col("page_id") % 2 == 0), a.where(F.col("page_id") % 2 == 1))


_DUCK_WORK = """WITH links AS (SELECT page_id AS post_id, url FROM pages),
done AS (SELECT page_id AS post_id FROM pages WHERE page_id % 3 = 0),
saved AS (SELECT page_id AS post_id FROM pages WHERE page_id % 2 = 0),
skip AS (SELECT post_id FROM done WHERE post_id NOT IN (SELECT post_id FROM saved))
SELECT post_id, url FROM links WHERE post_id NOT IN (SELECT post_id FROM skip)"""


def _work_inputs(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    links = p.select(F.col("page_id").alias("post_id"), "url")
    done = p.where(F.col("page_id") % 3 == 0).select(F.col("page_id").alias("post_id"))
    saved = p.where(F.col("page_id") % 2 == 0).select(F.col("page_id").alias("post_id"))
    return links, done, saved


@register("page_worklist", _DUCK_WORK)
def q_page_worklist(spark, sf_dir):
    """Posts to (re)process given finished outputs and saved pages."""
    return P.worklist(*_work_inputs(spark, sf_dir))


@register("page_worklist_cached", _DUCK_WORK + " AND post_id IN (SELECT post_id FROM saved)")
def q_page_worklist_cached(spark, sf_dir):
    """P7 with cached_only: only posts whose page is saved."""
    return P.worklist(*_work_inputs(spark, sf_dir), cached_only=True)


LISTING_SEED, LISTING_N = 7, 10


@register(
    "listing_urls",
    "WITH names AS (SELECT DISTINCT source AS name FROM documents), urls AS ("
    + " UNION ".join(
        "SELECT " + " || ".join(x for x in (D.q(t.split('{}')[0]), "name", D.q(t.split('{}')[1]) if t.split('{}')[1] else None) if x)
        + " AS url FROM names"
        for t in P.LISTING_TEMPLATES
    )
    + f") SELECT url FROM urls ORDER BY md5('{LISTING_SEED}:' || url), url LIMIT {LISTING_N}",
)
def q_listing_urls(spark, sf_dir):
    """Listing URLs for every community name found in the data, seeded sample of 10."""
    names = V.table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    return P.listing_urls(names, n=LISTING_N, seed=LISTING_SEED)


@register(
    "doc_sample",
    "SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 25",
)
def q_doc_sample(spark, sf_dir):
    """Deterministic sample of 25 documents without replacement."""
    return P.sample_rows(V.table(spark, sf_dir, "documents"), "doc_id", 25, seed=42).select("doc_id", "lang", "n_chars")


# ------------------------------------------------------------------ corpora


@register(
    "corpus_paragraph",
    f"""WITH u AS ({V.duck_page_units()}),
d AS (SELECT unnest({D.html_to_paragraphs('text')}) AS doc FROM u UNION SELECT title FROM u WHERE title IS NOT NULL)
SELECT doc FROM d WHERE length(doc) > 50 AND length(doc) < 1000""",
)
def q_corpus_paragraph(spark, sf_dir):
    """Paragraph corpus over stored pages."""
    return C.paragraph_corpus(V.page_units(spark, sf_dir))


@register(
    "corpus_html",
    f"WITH u AS ({V.duck_forest()}) SELECT id, text AS doc FROM u WHERE length(text) BETWEEN 50 AND 1000",
)
def q_corpus_html(spark, sf_dir):
    """HTML corpus over the forest."""
    return C.html_corpus(V.forest(spark, sf_dir))


@register(
    "corpus_source",
    f"""WITH u AS ({V.duck_forest()}),
d AS (SELECT DISTINCT CASE WHEN title IS NOT NULL THEN title || ' ' || chr(10) || ' ' || {D.html_to_source('text')} ELSE {D.html_to_source('text')} END AS doc FROM u)
SELECT doc FROM d WHERE length(doc) BETWEEN 50 AND 1000""",
)
def q_corpus_source(spark, sf_dir):
    """Source corpus over the forest."""
    return C.source_corpus(V.forest(spark, sf_dir))


@register(
    "corpus_chain",
    _duck_walk(V.duck_conv())
    + f""",
pieces AS (SELECT m.chain_id, m.chain_rank, u."user",
  CASE WHEN u.title IS NOT NULL THEN chr(10) || ' ' || u.title ELSE '' END || chr(10) || ' ' || {D.html_to_source('u.text')} AS piece
  FROM members m JOIN u ON u.id = m.member),
docs AS (SELECT chain_id, coalesce(arg_min("user", chain_rank), 'None') || ' says:' || string_agg(piece, '' ORDER BY chain_rank) AS doc
  FROM pieces GROUP BY chain_id)
SELECT chain_id, doc FROM docs WHERE length(doc) BETWEEN 50 AND 1000""",
)
def q_corpus_chain(spark, sf_dir):
    """C4: chain corpus over conversation threads."""
    return C.chain_corpus(V.conv(spark, sf_dir))


@register(
    "corpus_chain_forest",
    _duck_walk(V.duck_forest())
    + f""",
line AS (SELECT id, "user", CASE WHEN title IS NOT NULL THEN chr(10) || ' ' || title ELSE '' END || chr(10) || ' ' || {D.html_to_source('text')} AS piece FROM u),
docs AS (SELECT m.chain_id, coalesce(arg_min("user", m.chain_rank), 'None') || ' says:' || string_agg(piece, '' ORDER BY m.chain_rank) AS doc
  FROM members m JOIN line l ON l.id = m.member GROUP BY m.chain_id)
SELECT chain_id, doc FROM docs WHERE length(doc) BETWEEN 50 AND 1000000""",
)
def q_corpus_chain_forest(spark, sf_dir):
    """C4: chain corpus over branching threads, bounds wide enough to keep nearly every chain."""
    return C.chain_corpus(V.forest(spark, sf_dir), 50, 1_000_000)


# ------------------------------------------------------------------ ranking


def _v5(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    p = V.table(spark, sf_dir, "pages")
    html = F.coalesce(F.col("html"), F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")))
    return d.join(p, d["doc_id"] == p["page_id"], "left").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("source_text"), html.alias("text")
    )


_RANKS4 = ["source_text_char_rank", "text_char_rank", "source_text_nonalnum_rank", "text_nonalnum_rank"]


@register(
    "quality_rank",
    f"""WITH v AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text AS source_text, coalesce(p.html, '<p>' || d.text || '</p>') AS text FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id),
f AS (SELECT *, length(source_text) AS sl, length(text) AS tl, {D.nonalnum_distinct('source_text')} AS sn, {D.nonalnum_distinct('text')} AS tn
      FROM v WHERE source_text IS NOT NULL AND length(source_text) > 25),
r AS (SELECT *, CAST(rank() OVER (ORDER BY sl) AS DOUBLE) AS source_text_char_rank, CAST(rank() OVER (ORDER BY tl) AS DOUBLE) AS text_char_rank,
      CAST(rank() OVER (ORDER BY sn DESC) AS DOUBLE) AS source_text_nonalnum_rank, CAST(rank() OVER (ORDER BY tn DESC) AS DOUBLE) AS text_nonalnum_rank FROM f),
g AS (SELECT *, source_text_char_rank * text_char_rank * source_text_nonalnum_rank * text_nonalnum_rank AS prod FROM r WHERE text_char_rank < 50)
SELECT id, {', '.join(_RANKS4)}, CAST(rank() OVER (ORDER BY prod) AS DOUBLE) AS rank FROM g""",
)
def q_quality_rank(spark, sf_dir):
    """source/HTML quality ranking over every document (its page, or its text as one paragraph)."""
    return R.quality_rank(_v5(spark, sf_dir), X.nonalnum_distinct).select("id", *_RANKS4, "rank")


def q_quality_rank_histogram(spark, sf_dir):
    """R4 under its earlier name: the histogram form is the only one."""
    return R.quality_rank(_v5(spark, sf_dir), X.nonalnum_distinct).select("id", *_RANKS4, "rank")


register("quality_rank_histogram", ORACLES["quality_rank"])(q_quality_rank_histogram)


def _duck_avg_rank(expr: str, asc: bool) -> str:
    d = "" if asc else " DESC"
    return f"(CAST(rank() OVER (ORDER BY {expr}{d}) AS DOUBLE) + CAST(count(*) OVER (PARTITION BY {expr}) - 1 AS DOUBLE) / 2)"


def _duck_trial_rank() -> str:
    fills = ", ".join(
        f"coalesce({m}, (SELECT {'min' if f == 'min' else 'max'}({m}) FROM t)) AS f_{m}" for m, _, f, _ in R.TRIAL_RANKS
    )
    ranks = ", ".join(f"{_duck_avg_rank('f_' + m, asc)} AS {out}" for m, out, _, asc in R.TRIAL_RANKS)
    prod = " * ".join(out for _, out, _, _ in R.TRIAL_RANKS)
    outs = ", ".join(out for _, out, _, _ in R.TRIAL_RANKS)
    return f"""WITH t AS ({V.DUCK_TRIALS}),
f AS (SELECT trial_id, {fills} FROM t),
r AS (SELECT trial_id, {ranks} FROM f),
p AS (SELECT *, {prod} AS prod FROM r)
SELECT trial_id, {outs}, {_duck_avg_rank('prod', True)} AS total_score FROM p"""


@register("trial_rank", _duck_trial_rank())
def q_trial_rank(spark, sf_dir):
    """Trial scoring over the trial-log stand-in."""
    out = [o for _, o, _, _ in R.TRIAL_RANKS]
    return R.rank_trials(V.trials(spark, sf_dir)).select("trial_id", *out, "total_score")


@register(
    "trial_rank_histogram",
    _duck_trial_rank(),
)
def q_trial_rank_histogram(spark, sf_dir):
    """R5 under its earlier name: the histogram form is the only one."""
    out = [o for _, o, _, _ in R.TRIAL_RANKS]
    return R.rank_trials(V.trials(spark, sf_dir)).select("trial_id", *out, "total_score")


_METRICS = [m for m, *_ in R.TRIAL_RANKS]


@register(
    "column_bounds",
    f"WITH t AS ({V.DUCK_TRIALS}) "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS \"column\", CAST(min({m}) AS DOUBLE) AS min_value, CAST(max({m}) AS DOUBLE) AS max_value, count(DISTINCT {m}) AS n_distinct FROM t"
        for m in _METRICS
    ),
)
def q_column_bounds(spark, sf_dir):
    """Min, max and distinct count of every trial metric."""
    return R.column_bounds(V.trials(spark, sf_dir), _METRICS)


# ------------------------------------------------------------------ phrases, vocabulary, bag of words
from pyspark.sql import Window  # noqa: E402

from threadspark.operators import phrases as PH  # noqa: E402
from threadspark.operators import topics as TP  # noqa: E402
from threadspark.operators import vocab as VB  # noqa: E402


def _doc_tokens(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", X.tokenize(F.col("text")).alias("tokens"))


def _duck_doc_tokens() -> str:
    return f"SELECT doc_id, lang, source, {D.tokenize('text')} AS t FROM documents"


def _duck_phrase_base() -> str:
    return f"""d AS ({_duck_doc_tokens()}),
uni AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM d) GROUP BY w),
pairs AS (SELECT doc_id, generate_subscripts(list_slice(t, 1, len(t) - 1), 1) - 1 AS pos,
                 unnest(list_slice(t, 1, len(t) - 1)) AS a, unnest(list_slice(t, 2, len(t))) AS b FROM d WHERE len(t) > 1),
bi AS (SELECT a, b, count(*) AS n_ab FROM pairs GROUP BY a, b),
vs AS (SELECT count(DISTINCT k) AS v FROM (SELECT w AS k FROM uni UNION ALL SELECT a || '_' || b FROM bi)),
tot AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM uni),
s AS (SELECT bi.a, bi.b, n_ab, ua.n AS n_a, ub.n AS n_b FROM bi JOIN uni ua ON ua.w = bi.a JOIN uni ub ON ub.w = bi.b)"""


def _duck_default_score(min_count: int) -> str:
    return f"CAST(n_ab - {min_count} AS DOUBLE) / CAST(n_a * n_b AS DOUBLE) * (SELECT v FROM vs)"


def _duck_npmi_score(min_count: int) -> str:
    tot = "(SELECT total FROM tot)"
    pab, pa, pb = (f"(CAST({c} AS DOUBLE) / {tot})" for c in ("n_ab", "n_a", "n_b"))
    return f"CASE WHEN n_ab >= {min_count} THEN ln({pab} / ({pa} * {pb})) / -ln({pab}) END"


PHRASE_DEFAULT = dict(min_count=1, threshold=10.0, scoring="default")
PHRASE_NPMI = dict(min_count=5, threshold=0.5, scoring="npmi")
PHRASE_APPLY = dict(min_count=5, threshold=10.0, scoring="default")


def _phrase_query(params):
    def q(spark, sf_dir):
        s = PH.learn_phrases(_doc_tokens(spark, sf_dir), **params)
        return s.select("a", "b", "phrase", "n_ab", "n_a", "n_b", F.round("score", 6).alias("score"))

    return q


def _duck_phrase_scores(params) -> str:
    score = (_duck_default_score if params["scoring"] == "default" else _duck_npmi_score)(params["min_count"])
    return f"""WITH {_duck_phrase_base()}
SELECT a, b, a || '_' || b AS phrase, n_ab, n_a, n_b, round(score, 6) AS score
FROM (SELECT *, {score} AS score FROM s) WHERE score > {params['threshold']}"""


register("phrase_scores_default", _duck_phrase_scores(PHRASE_DEFAULT))(_phrase_query(PHRASE_DEFAULT))
register("phrase_scores_npmi", _duck_phrase_scores(PHRASE_NPMI))(_phrase_query(PHRASE_NPMI))


@register(
    "phrase_apply",
    f"""WITH {_duck_phrase_base()},
phr AS (SELECT a, b FROM (SELECT *, {_duck_default_score(PHRASE_APPLY['min_count'])} AS score FROM s) WHERE score > {PHRASE_APPLY['threshold']}),
flag AS (SELECT p.doc_id, p.pos, p.a, p.b FROM pairs p WHERE EXISTS (SELECT 1 FROM phr WHERE phr.a = p.a AND phr.b = p.b)),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM flag),
st AS (SELECT doc_id, pos, a || '_' || b AS phrase FROM (SELECT *, pos - min(pos) OVER (PARTITION BY doc_id, grp) AS off FROM runs) WHERE off % 2 = 0),
toks AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token FROM d),
kept AS (SELECT t.doc_id, t.pos, coalesce(st.phrase, t.token) AS tok FROM toks t
         LEFT JOIN st ON st.doc_id = t.doc_id AND st.pos = t.pos
         WHERE NOT EXISTS (SELECT 1 FROM st s2 WHERE s2.doc_id = t.doc_id AND s2.pos + 1 = t.pos))
SELECT d.doc_id, CAST(count(k.tok) AS INTEGER) AS n_tokens, coalesce(string_agg(k.tok, ' ' ORDER BY k.pos), '') AS phrased_text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def q_phrase_apply(spark, sf_dir):
    """M2: greedy phrase merge of every document with the learned phrases."""
    # texts are cut anew by each of three passes: held, their tokens would take several times the texts' disk
    phr = PH.learn_phrases(_doc_tokens(spark, sf_dir), **PHRASE_APPLY)
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = PH.apply_phrases(docs, phr, tokens_col=X.tokenize(F.col("text")))
    return out.select("doc_id", F.size("phrased").alias("n_tokens"), F.array_join("phrased", " ").alias("phrased_text"))


VOCAB = dict(no_below=5, no_above=0.2)


def _duck_vocab() -> str:
    return f"""d AS ({_duck_doc_tokens()}),
dfs AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM d) GROUP BY term),
vocab AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS term_id, df FROM dfs
          WHERE df >= {VOCAB['no_below']} AND df <= floor({VOCAB['no_above']} * (SELECT count(*) FROM documents)))"""


@register("vocabulary", f"WITH {_duck_vocab()} SELECT term, CAST(term_id AS INTEGER) AS term_id, df FROM vocab")
def q_vocabulary(spark, sf_dir):
    """M3: document-frequency filtered vocabulary with deterministic term ids."""
    return VB.build_vocabulary(_doc_tokens(spark, sf_dir), **VOCAB)


@register(
    "bag_of_words",
    f"""WITH {_duck_vocab()}
SELECT doc_id, CAST(term_id AS INTEGER) AS term_id, count(*) AS cnt
FROM (SELECT doc_id, unnest(t) AS term FROM d) x JOIN vocab USING (term) GROUP BY doc_id, term_id""",
)
def q_bag_of_words(spark, sf_dir):
    """M4: bag of words over all tokens of every document."""
    toks = materialize(_doc_tokens(spark, sf_dir).select("doc_id", "tokens"))  # read twice
    return VB.bag_of_words(toks, VB.build_vocabulary(toks, **VOCAB))


# ------------------------------------------------------------------ topic metrics on data-derived topics
# "Topics" are languages (top terms by document frequency within the language);
# the second run for stability are sources. Weights = share of the group's tokens.


def _group_top_terms(t, group: str, n: int, weight: bool = False):
    """Top-``n`` terms per ``group`` of the token table ``t`` (by document frequency, or by count with weights)."""
    if weight:
        cnt = t.select(group, F.explode("tokens").alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("c"))
        tot = cnt.groupBy(group).agg(F.sum("c").alias("n"))
        order = [F.desc("c"), F.asc("term")]
    else:
        cnt = t.select(group, "doc_id", F.explode(F.array_distinct("tokens")).alias("term")).groupBy(group, "term").agg(
            F.count(F.lit(1)).alias("c")
        )
    ranked = cnt.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("c"), F.asc("term"))))
    # a filter directly on the row number is planned as a per-partition top-n before the shuffle
    top = ranked.where(F.col("_rn") <= n).withColumn("rank", F.col("_rn") - 1).drop("_rn")
    if weight:
        top = top.join(tot, group).withColumn("weight", F.col("c") / F.col("n"))
    return top.withColumnRenamed(group, "topic")


def _duck_group_top(group: str, n: int, weight: bool = False) -> str:
    if weight:
        base = f"SELECT {group} AS topic, term, count(*) AS c FROM (SELECT {group}, unnest(t) AS term FROM d) GROUP BY {group}, term"
    else:
        base = f"SELECT {group} AS topic, term, count(*) AS c FROM (SELECT DISTINCT {group}, doc_id, unnest(t) AS term FROM d) GROUP BY {group}, term"
    sel = "topic, term, c, rank" + (", CAST(c AS DOUBLE) / (SELECT sum(c) FROM b2 WHERE b2.topic = r.topic) AS weight" if weight else "")
    return f"""(WITH b2 AS ({base})
SELECT {sel} FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY c DESC, term) - 1 AS rank FROM b2) r WHERE rank < {n})"""


@register(
    "coherence_umass",
    f"""WITH d AS ({_duck_doc_tokens()}),
top AS {_duck_group_top('lang', TP.COHERENCE_TOPN)},
occ AS (SELECT DISTINCT doc_id, unnest(t) AS term FROM d),
dfq AS (SELECT term, count(*) AS df FROM occ WHERE term IN (SELECT term FROM top) GROUP BY term),
pairs AS (SELECT i.topic, i.term AS wi, j.term AS wj FROM top i JOIN top j ON i.topic = j.topic AND j.rank < i.rank),
co AS (SELECT p.topic, p.wi, p.wj, count(*) AS co FROM pairs p JOIN occ oi ON oi.term = p.wi JOIN occ oj ON oj.doc_id = oi.doc_id AND oj.term = p.wj GROUP BY ALL),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents)
SELECT p.topic, round(avg(ln((CAST(coalesce(co.co, 0) AS DOUBLE) / (SELECT n FROM n) + {TP.UMASS_EPSILON}) / (CAST(dfq.df AS DOUBLE) / (SELECT n FROM n)))), 9) AS coherence
FROM pairs p LEFT JOIN co USING (topic, wi, wj) JOIN dfq ON dfq.term = p.wj GROUP BY p.topic""",
)
def q_coherence_umass(spark, sf_dir):
    """M7: UMass coherence of each language's top-20 terms over all documents."""
    toks = materialize(_doc_tokens(spark, sf_dir))  # read twice
    top = _group_top_terms(toks, "lang", TP.COHERENCE_TOPN)
    occ = toks.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term"))
    n = V.table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    c = TP.umass_coherence(top, occ, n, id_col="doc_id", term_col="term")
    return c.select("topic", F.round("coherence", 9).alias("coherence"))


@register(
    "topic_diversity",
    f"""WITH d AS ({_duck_doc_tokens()}), top AS {_duck_group_top('source', TP.TOPIC_TOPN)}
SELECT count(DISTINCT term) / count(*) AS diversity FROM top""",
)
def q_topic_diversity(spark, sf_dir):
    """Diversity of the sources' top-10 terms."""
    return TP.topic_diversity(_group_top_terms(_doc_tokens(spark, sf_dir), "source", TP.TOPIC_TOPN), term_col="term")


@register(
    "doc_entropy",
    f"""WITH d AS ({_duck_doc_tokens()}),
c AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY doc_id, term),
p AS (SELECT doc_id, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY doc_id) AS p FROM c)
SELECT d0.doc_id, round(coalesce(-sum(CASE WHEN p >= {TP.MIN_TOPIC_PROB} THEN p * ln(p) END), 0), 9) AS entropy
FROM documents d0 LEFT JOIN p ON p.doc_id = d0.doc_id GROUP BY d0.doc_id""",
)
def q_doc_entropy(spark, sf_dir):
    """Entropy of every document's term distribution (probabilities below 0.01 dropped)."""
    # one shuffle of the per-document token arrays by doc_id; both aggregations below are then local
    t = _doc_tokens(spark, sf_dir).select("doc_id", "tokens").repartition("doc_id")
    c = t.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("c"))
    p = c.groupBy("doc_id").agg(F.collect_list("c").alias("cs"), F.sum("c").alias("n"))  # one row per document
    p = p.select("doc_id", F.transform("cs", lambda x: x / F.col("n")).alias("p"))
    e = V.table(spark, sf_dir, "documents").select("doc_id").join(
        p.select("doc_id", TP.distribution_entropy(F.col("p")).alias("entropy")), "doc_id", "left"
    )
    return e.select("doc_id", F.round(F.coalesce("entropy", F.lit(0.0)), 9).alias("entropy"))


@register(
    "topic_stability",
    f"""WITH d AS ({_duck_doc_tokens()}),
ra AS {_duck_group_top('lang', TP.TOPIC_TOPN, True)},
rb AS {_duck_group_top('source', TP.TOPIC_TOPN, True)},
pairs AS (SELECT a.topic AS t1, b.topic AS t2 FROM (SELECT DISTINCT topic FROM ra) a CROSS JOIN (SELECT DISTINCT topic FROM rb) b),
terms AS (SELECT t1, t2, term FROM pairs JOIN ra ON ra.topic = t1 UNION SELECT t1, t2, term FROM pairs JOIN rb ON rb.topic = t2),
h AS (SELECT t1, t2, sqrt(0.5 * sum(pow(sqrt(coalesce(ra.weight, 0)) - sqrt(coalesce(rb.weight, 0)), 2))) AS h
      FROM terms LEFT JOIN ra ON ra.topic = t1 AND ra.term = terms.term LEFT JOIN rb ON rb.topic = t2 AND rb.term = terms.term
      GROUP BY t1, t2)
SELECT t1 AS topic, round(min(h), 9) AS min_hellinger FROM h GROUP BY t1""",
)
def q_topic_stability(spark, sf_dir):
    """Per language topic, min Hellinger distance to any source topic (top-10 sparse)."""
    toks = materialize(_doc_tokens(spark, sf_dir))  # read by both runs
    a = _group_top_terms(toks, "lang", TP.TOPIC_TOPN, weight=True)
    b = _group_top_terms(toks, "source", TP.TOPIC_TOPN, weight=True)
    h = TP.hellinger_min(a, b, term_col="term")
    return h.select("topic", F.round("min_hellinger", 9).alias("min_hellinger"))


# ------------------------------------------------------------------ topic models (rows-only: stochastic)
from threadspark.operators import search as S  # noqa: E402

LDA_PARAMS = dict(k=5, chunksize=1000, passes=2, decay=0.7, alpha="asymmetric", eta="auto")


def _lda_inputs(spark, sf_dir):
    toks = _doc_tokens(spark, sf_dir).select("doc_id", "tokens")
    vocab = materialize(VB.build_vocabulary(toks, no_below=5, no_above=0.5, keep_n=VB.KEEP_N))
    vectors = materialize(TP.spread(VB.bow_vectors(toks, vocab)))
    return vocab, vectors


def _lda_model(spark, sf_dir, seed=0):
    vocab, vectors = _lda_inputs(spark, sf_dir)
    est = TP.lda_estimator(n_docs=vectors.count(), seed=seed, update_every=TP.chunks_per_update(spark), **LDA_PARAMS)
    return est.fit(vectors), vocab, vectors


@register("lda_topics")
def q_lda_topics(spark, sf_dir):
    """M5/M9: online LDA on all documents, top-10 terms per topic."""
    model, vocab, _ = _lda_model(spark, sf_dir)
    return TP.topic_terms(model, vocab, TP.TOPIC_TOPN)


@register("lda_doc_topics")
def q_lda_doc_topics(spark, sf_dir):
    """Per-document topic entropy under the fitted model."""
    model, _, vectors = _lda_model(spark, sf_dir)
    return TP.doc_entropy(model, vectors)


@register("lda_metrics")
def q_lda_metrics(spark, sf_dir):
    """Two fits with different seeds; coherence, perplexity, diversity, entropy, stability."""
    vocab, vectors = _lda_inputs(spark, sf_dir)
    n, every = vectors.count(), TP.chunks_per_update(spark)
    m1, m2 = TP.fit_each(vectors, [TP.lda_estimator(n_docs=n, seed=seed, update_every=every, **LDA_PARAMS) for seed in (0, 1)])
    toks = _doc_tokens(spark, sf_dir).select("doc_id", "tokens")
    top = TP.topic_terms(m1, vocab, TP.COHERENCE_TOPN)
    # coherence asks for the topics' top terms only; held, as it asks twice
    occ = materialize(TP.doc_terms(VB.bag_of_words(toks, vocab.join(top, "term_id", "left_semi"))))
    k = LDA_PARAMS["k"]
    coh = TP.umass_coherence(top, occ, n).agg(F.sum("coherence") / k)
    div = TP.topic_diversity(TP.topic_terms(m1, vocab))
    inferred = materialize(TP.doc_bounds(m1, vectors))  # read twice
    ent = TP.doc_entropy(m1, vectors, inferred=inferred).agg(F.avg("entropy"))
    stab = TP.hellinger_min(TP.topic_terms(m1, vocab), TP.topic_terms(m2, vocab)).agg(F.sum("min_hellinger") / k)
    return spark.range(1).select(
        coh.scalar().alias("avg_topic_coherence"),
        (-TP.log_perplexity(m1, inferred)).alias("perplexity"),
        div.scalar().alias("diversity"),
        ent.scalar().alias("avg_entropy"),
        stab.scalar().alias("stability_score"),
    )


TRIAL_PARAMS_Q = dict(
    lda_num_topics=4, chunksize=500, passes=2, iterations=50, decay=0.7, alpha="symmetric", eta="symmetric",
    no_below=2, no_above=0.5, min_len=50, max_len=20000, phraser_min_count=5, phraser_threshold=10,
    phraser_scorer="default", dataset="post", max_input_jsons=None,
)


@register("lda_trial")
def q_lda_trial(spark, sf_dir):
    """One full trial over every thread (corpus -> tokens -> phrases -> vocabulary -> 2 LDA fits -> 6 metrics)."""
    units = materialize(S.thread_ids(V.forest(spark, sf_dir)))
    rec = S.run_trial(units, TRIAL_PARAMS_Q, seed=0)
    return S.trial_frame(spark, [rec])


# ------------------------------------------------------------------ parameter search over a trial-log stand-in


def _trial_params(spark, sf_dir):
    """Parameters per supplier (numeric and categorical) + the trial score of R5."""
    li = V.table(spark, sf_dir, "lineitem")
    params = li.groupBy(F.col("l_suppkey").alias("trial_id")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.round(F.avg("l_extendedprice"), 2).alias("avg_price"),
        F.max("l_quantity").alias("max_qty"),
        F.min("l_returnflag").alias("flag"),
    )
    scores = R.rank_trials(V.trials(spark, sf_dir)).select("trial_id", "total_score")
    return params.join(scores, "trial_id")


SEARCH_PARAMS = ["n_lines", "avg_price", "max_qty", "flag"]
_NUMERIC_V4 = ["avg_topic_coherence", "perplexity", "diversity", "avg_entropy", "stability_score", "model_training_time"]


@register(
    "interactions",
    f"WITH t AS ({V.DUCK_TRIALS}) SELECT *, "
    + ", ".join(f"{a} * {b} AS {a}_x_{b}" for i, a in enumerate(_NUMERIC_V4) for b in _NUMERIC_V4[i + 1:])
    + " FROM t",
)
def q_interactions(spark, sf_dir):
    """H3: pairwise products of the numeric trial columns."""
    return S.interactions(V.trials(spark, sf_dir), _NUMERIC_V4)


def _duck_draw(name: str, seed: int = 3) -> str:
    return f"(CAST(CAST('0x' || substr(md5('{seed}:{name}:' || i), 1, 13) AS BIGINT) AS DOUBLE) / {16**13}::DOUBLE)"


@register(
    "trial_candidates",
    f"""WITH p AS (SELECT count(*) AS n_lines, round(avg(l_extendedprice), 2) AS avg_price, max(l_quantity) AS max_qty, min(l_returnflag) AS flag FROM lineitem GROUP BY l_suppkey),
b AS (SELECT {', '.join(f"CAST({f}({c}) AS DOUBLE) AS {c}_{f}" for c in ("n_lines", "avg_price", "max_qty") for f in ("min", "max"))}, list_sort(list(DISTINCT flag)) AS flags FROM p)
SELECT {', '.join(f"{c}_min + {_duck_draw(c)} * ({c}_max - {c}_min) AS {c}" for c in ("n_lines", "avg_price", "max_qty"))},
  flags[CAST(floor({_duck_draw('flag')} * len(flags)) AS BIGINT) + 1] AS flag FROM range(1000) AS t(i), b""",
)
def q_trial_candidates(spark, sf_dir):
    """H6: 1000 candidates drawn from the observed parameter ranges and categories."""
    return S.candidates(_trial_params(spark, sf_dir), SEARCH_PARAMS, 1000, seed=3)


@register("param_search")
def q_param_search(spark, sf_dir):
    """H5-H8: GBT on parameters + interactions -> scored, sorted candidates."""
    return S.predictive_search(
        _trial_params(spark, sf_dir), {"flag": "N"}, "total_score", SEARCH_PARAMS, iterations=1000,
        max_iter=10, max_depth=4,
    )


@register("seed_trials")
def q_seed_trials(spark, sf_dir):
    """The first 5 predicted parameter sets without score columns."""
    pred = S.predictive_search(_trial_params(spark, sf_dir), {}, "total_score", SEARCH_PARAMS, iterations=500,
                               max_iter=5, max_depth=3)
    return S.seed_trials(pred, 5)


# ------------------------------------------------------------------ nested thread documents
from threadspark.operators import nesting as N  # noqa: E402
from threadspark.schemas import CONTENT_COLUMNS  # noqa: E402


def _duck_nest(units_sql: str) -> str:
    fields = ", ".join(f"'{c}', u.\"{c}\"" for c in CONTENT_COLUMNS)
    return f"""WITH RECURSIVE u AS ({units_sql}),
walk(id, root, path) AS (
  SELECT id, id, [id] FROM u WHERE is_post
  UNION ALL
  SELECT c.id, w.root, list_append(w.path, c.id) FROM u c JOIN walk w ON c.parent_id = w.id WHERE NOT c.is_post
),
line AS (SELECT root, path, len(path) AS d, CAST(json_object({fields}) AS VARCHAR) AS own FROM walk w JOIN u ON u.id = w.id),
near AS (SELECT *, lag(d) OVER p AS before, lead(d) OVER p AS after FROM line WINDOW p AS (PARTITION BY root ORDER BY path)),
piece AS (SELECT root, path, CASE WHEN before >= d THEN ',' ELSE '' END || left(own, -1) || ',"replies":['
  || repeat(']}}', CAST(greatest(d - coalesce(after, 1) + 1, 0) AS BIGINT)) AS t FROM near)
SELECT root AS id, string_agg(t, '' ORDER BY path) AS json FROM piece GROUP BY root"""


@register("nest_threads", _duck_nest(V.duck_forest()))
def q_nest_threads(spark, sf_dir):
    """One nested JSON document per forest thread."""
    return N.nest_threads(V.forest(spark, sf_dir))


@register("flatten_threads", V.duck_conv())
def q_flatten_threads(spark, sf_dir):
    """T1 over T2: conversation threads nested to JSON, parsed as VARIANT and flattened back."""
    docs = N.nest_threads(V.conv(spark, sf_dir)).withColumnRenamed("id", "thread")
    return N.flatten_threads(docs, json_col="json", key_col="thread").select(*CONTENT_COLUMNS)


@register("flatten_forest", V.duck_forest())
def q_flatten_forest(spark, sf_dir):
    """T1 over T2 on branching threads (four levels)."""
    docs = N.nest_threads(V.forest(spark, sf_dir)).withColumnRenamed("id", "thread")
    return N.flatten_threads(docs, json_col="json", key_col="thread").select(*CONTENT_COLUMNS)


# ------------------------------------------------------------------ thread files


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _thread_of(path: str):
    return F.regexp_extract(path, r"thread=([^/]+)/", 1)


@register("thread_files", V.duck_conv())
def q_thread_files(spark, sf_dir):
    """K4 + S1/S3/S5: conversation threads written as one file each and all read back."""
    path = _folder(spark, "threads")
    WR.write_thread_documents(V.conv(spark, sf_dir), path, fmt="files")
    return RD.read_threads(spark, path, suffix=".txt").select(*CONTENT_COLUMNS)


@register(
    "thread_file_sample",
    f"""WITH u AS ({V.duck_conv()}), pick AS (SELECT id FROM u WHERE is_post ORDER BY md5('7:' || id), id LIMIT 20)
SELECT p.id AS thread, u.id, u.parent_id, u.text FROM u JOIN pick p ON split_part(u.id, '-', 1) = split_part(p.id, '-', 1)""",
)
def q_thread_file_sample(spark, sf_dir):
    """20 thread files sampled from the listing; only those are read."""
    path = _folder(spark, "threads")
    WR.write_thread_documents(V.conv(spark, sf_dir), path, fmt="files")
    rows = RD.read_threads(spark, path, max_docs=20, seed=7, suffix=".txt", key=_thread_of("path"))
    return rows.select(_thread_of("thread").alias("thread"), "id", "parent_id", "text")


@register(
    "thread_load",
    """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS cid, conv_id % 5 AS k, turn FROM conversations)
SELECT CASE WHEN k NOT IN (1, 2) THEN cid || '-0' END AS thread, CASE WHEN k NOT IN (1, 2) THEN cid || '-' || turn END AS id,
  CASE WHEN k = 1 THEN 'not JSON' WHEN k = 2 THEN 'not a document' WHEN k = 3 AND turn > 0 THEN 'ill-typed is_post'
    WHEN k = 4 AND turn = 1 THEN 'missing date' WHEN k = 4 AND turn > 1 THEN 'below a rejected unit' END AS reason
FROM c WHERE k NOT IN (1, 2) OR turn = 0""",
)
def q_thread_load(spark, sf_dir):
    """Thread documents, four fifths of them damaged in four ways, written and loaded with every reject and its reason."""
    units = V.conv(spark, sf_dir)
    k = F.substring_index("id", "-", 1).cast("long") % 5
    units = units.withColumn("date", F.when((k == 4) & F.col("id").endswith("-1"), F.lit(None)).otherwise(F.col("date")))
    damaged = (
        F.when(k == 1, F.expr("substring(json, 1, length(json) DIV 2)")).when(k == 2, F.lit("[1]"))
        .when(k == 3, F.replace("json", F.lit('"is_post":false'), F.lit('"is_post":"maybe"'))).otherwise(F.col("json"))
    )
    path = _folder(spark, "damaged")
    N.nest_threads(units).select(damaged.alias("value")).write.text(path)
    return RD.load_files(spark, path, fmt="lines").select("thread", "id", "reason")


# ------------------------------------------------------------------ batch scoring and incremental ingest
import uuid  # noqa: E402

from threadspark.session import ensure_checkpoint_dir  # noqa: E402
from threadspark.streaming import ingest as Z  # noqa: E402

N_ANSWERS = 20


def stub_model(texts: list[str]) -> list[str]:
    """Deterministic stand-in for a text model: answers A1..A20 derived from the input length."""
    return ["\n".join(f"A{i}: {((len(t) * i) % 101) / 100}" for i in range(1, N_ANSWERS + 1)) for t in texts]


def _scored(spark, sf_dir):
    inputs = L.apply_template(L.chain_prompts(V.conv(spark, sf_dir)), TEMPLATE)
    return L.score_prompts(inputs, stub_model)


@register(
    "stub_scoring",
    "SELECT chain_id, id, CAST(length(model_input) AS BIGINT) AS input_chars, array_to_string(list_transform(range(1, 21), "
    "lambda i: 'A' || i || ': ' || CAST(CAST((length(model_input) * i) % 101 AS DOUBLE) / 100 AS VARCHAR)), chr(10)) AS output FROM ("
    + "SELECT chain_id, id, " + f"'{TEMPLATE}' || ' ' || chr(10) || ' ' || prompt AS model_input FROM ("
    + _duck_prompts(V.duck_conv())
    + "))",
)
def q_stub_scoring(spark, sf_dir):
    """L3: every templated prompt scored in Arrow batches by a caller-supplied model (the seconds each took left out)."""
    return _scored(spark, sf_dir).drop("seconds")


@register(
    "answer_parse",
    "SELECT chain_id, id, "
    + ", ".join(f"((length(model_input) * {i}) % 101) / 100.0 AS a{i}" for i in range(1, N_ANSWERS + 1))
    + " FROM ("
    + "SELECT chain_id, id, " + f"'{TEMPLATE}' || ' ' || chr(10) || ' ' || prompt AS model_input FROM ("
    + _duck_prompts(V.duck_conv())
    + "))",
)
def q_answer_parse(spark, sf_dir):
    """L4: the A1..A20 answer lines of every model output as DOUBLE columns."""
    return L.parse_answers(_scored(spark, sf_dir), n=N_ANSWERS).select("chain_id", "id", *[f"a{i}" for i in range(1, N_ANSWERS + 1)])


@register("incremental_pages", "SELECT page_id, url, html FROM pages")
def q_incremental_pages(spark, sf_dir):
    """Stored pages ingested by an availableNow stream, de-duplicated by page id."""
    base = f"{ensure_checkpoint_dir(spark)}/incremental-pages-{uuid.uuid4().hex}"
    source, glob = Z.table_files(spark, sf_dir, "pages.parquet")
    Z.ingest_pages(spark, source, f"{base}/out", f"{base}/state", glob=glob)
    return spark.read.schema(Z.PAGES_SCHEMA).parquet(f"{base}/out")


# ------------------------------------------------------------------ thread pages
from threadspark.operators import threadpages as TPG  # noqa: E402


def _thread_pages(spark, sf_dir):
    return materialize(TPG.render_thread_pages(V.forest_units_for_pages(spark, sf_dir)))


@register("thread_pages", V.duck_thread_page_rows())
def q_thread_pages(spark, sf_dir):
    """Post and comment rows parsed from rendered thread pages (parse(render(forest)) = forest, with defaults for missing fields)."""
    return TPG.parse_thread_pages(_thread_pages(spark, sf_dir))


@register("thread_pages_subtree", V.duck_thread_page_rows("subtree"))
def q_thread_pages_subtree(spark, sf_dir):
    """P9 with sub-tree selector scope: a comment without an author, votes or flair takes those of its first reply that has them."""
    return TPG.parse_thread_pages(_thread_pages(spark, sf_dir), scope="subtree")


# ------------------------------------------------------------------ sink -> source round trips
from threadspark.sources import readers as RD  # noqa: E402
from threadspark.sources import writers as WR  # noqa: E402

_RT_COLS = ["id", "parent_id", "is_post", "user", "title", "text", "child_count", "chain_id", "chain_rank"]


def _duck_chain_children(units_sql: str) -> str:
    return (
        _duck_walk(units_sql)
        + """,
kids AS (SELECT parent_id, string_agg(id, ',' ORDER BY id) AS children FROM u WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT u.id, u.parent_id, u.is_post, u."user", u.title, u.text, coalesce(k.child_count, 0) AS child_count, m.chain_id, m.chain_rank,
       coalesce(kd.children, '') AS children
FROM members m JOIN u ON u.id = m.member LEFT JOIN counts k ON k.parent_id = u.id LEFT JOIN kids kd ON kd.parent_id = u.id"""
    )


@register("chain_csv_roundtrip", _duck_chain_children(V.duck_conv()))
def q_chain_csv_roundtrip(spark, sf_dir):
    """K1 + S6: the conversation chain table (with children ids) written as CSV and read back."""
    chains = T.chain_table(V.conv(spark, sf_dir), with_children_ids=True)
    path = f"{ensure_checkpoint_dir(spark)}/chain-csv-{uuid.uuid4().hex}"
    WR.write_chain_table(chains, path, fmt="csv")
    back = RD.read_chain_table(spark, path, fmt="csv")
    return back.select(*_RT_COLS, F.array_join("children_ids", ",").alias("children"))


@register(
    "chain_head",
    "SELECT chain_id, chain_rank, id FROM ("
    + _duck_chain_table(V.duck_conv())
    + ") ORDER BY chain_id, chain_rank LIMIT 100",
)
def q_chain_head(spark, sf_dir):
    """S6 head: the first 100 chain rows in (chain_id, chain_rank) order."""
    return RD.chain_head(T.chain_table(V.conv(spark, sf_dir)), 100).select("chain_id", "chain_rank", "id")


@register("predictions_roundtrip", ORACLES["trial_candidates"])
def q_predictions_roundtrip(spark, sf_dir):
    """K3 + S8's reader: a table of drawn parameters written as predictions and read back."""
    path, drawn = _folder(spark, "predictions"), q_trial_candidates(spark, sf_dir)
    WR.write_predictions(drawn, path)
    return RD.read_predictions(spark, path, drawn.schema)


@register("pages_roundtrip", "SELECT CAST(page_id AS VARCHAR) AS page_id, html FROM pages")
def q_pages_roundtrip(spark, sf_dir):
    """K5 + S10: pages written by crawl batch and read back."""
    path = _folder(spark, "pages")
    batch = (F.col("page_id") % 5).alias("batch")
    WR.write_pages(V.table(spark, sf_dir, "pages").select("page_id", "html", batch), path, partition_col="batch")
    return RD.read_saved_pages(spark, path, fmt="parquet")


@register("links_roundtrip", "SELECT CAST(page_id AS VARCHAR) AS post_id, url FROM pages")
def q_links_roundtrip(spark, sf_dir):
    """K6 + S9: the link map of all pages written and read back."""
    path = _folder(spark, "links")
    WR.write_link_map(V.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("post_id"), "url"), path)
    return RD.read_link_map(spark, path, fmt="parquet")


@register(
    "trial_log_roundtrip",
    f"WITH t AS ({V.DUCK_TRIALS}) SELECT {', '.join(m for m, *_ in R.TRIAL_RANKS)}, CASE WHEN trial_id % 3 = 0 THEN 'error' ELSE 'ok' END AS status FROM t",
)
def q_trial_log_roundtrip(spark, sf_dir):
    """K2 + S7: all trials appended in two batches, the second batch twice, compacted and read back."""
    metrics = [m for m, *_ in R.TRIAL_RANKS]
    trials = V.trials(spark, sf_dir).withColumn("number", F.col("trial_id"))
    plan = S.search_plan(spark, trials.agg(F.max("number") + 1).first()[0] or 0, seed=4).join(trials.select("number", *metrics), "number")
    status = F.when(F.col("number") % 3 == 0, F.lit("error")).otherwise(F.lit("ok")).alias("status")
    log = plan.select(*S.TRIAL_PARAMS, *metrics, status, F.lit(None).cast("string").alias("error"), "trial_id", "number")
    path, small = _folder(spark, "log"), _folder(spark, "log")
    for odd in (0, 1, 1):
        WR.append_trials(log.where(F.col("number") % 2 == odd).drop("number"), path)
    WR.compact_trials(spark, path, small)
    return RD.read_trials(spark, small).select(*metrics, "status")


@register(
    "corpus_by_name",
    f"""SELECT 'post' AS dataset, doc FROM ({ORACLES["corpus_source"]}) UNION ALL SELECT 'post_html', doc FROM ({ORACLES["corpus_html"]})""",
)
def q_corpus_by_name(spark, sf_dir):
    """Corpora of the forest by dataset name."""
    units = V.forest(spark, sf_dir)
    made = [C.build_corpus(units, name).select(F.lit(name).alias("dataset"), "doc") for name in ("post", "post_html")]
    return made[0].unionByName(made[1])
