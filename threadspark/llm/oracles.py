"""DuckDB SQL of the operators that SQL can express, written apart from the Spark code."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

CONTAINED = rf"""
WITH item AS (
  SELECT item_id, text, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: ' ' || array_to_string(w[i:i+4], ' ') || ' ')) AS s
  FROM (SELECT DISTINCT item_id, text, {PLAIN.format(LOWER)} AS w FROM benchmark) WHERE len(w) >= 1
), doc AS (SELECT doc_id, ' ' || array_to_string({PLAIN.format(LOWER)}, ' ') || ' ' AS t FROM documents),
hit AS (
  SELECT doc_id, item_id, len(s) AS n_shingles, len(list_filter(s, lambda x: contains(t, x))) AS n_matched FROM doc, item
)
SELECT DISTINCT doc_id, item_id, CAST(n_shingles AS BIGINT) AS n_shingles, CAST(n_matched AS BIGINT) AS n_matched, n_matched / n_shingles AS containment
FROM hit WHERE 100 * n_matched >= 80 * n_shingles"""

#: Windows as whole strings: brute force over the small tables.
BYTE_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n_bytes FROM d),
c AS (SELECT doc_id, k, substr(h, 512 * k + 1, 610) AS part FROM (SELECT doc_id, h, unnest(range(0, n_bytes // 256 + 1)) AS k FROM n)),
w AS (SELECT doc_id, 256 * k + j AS i, md5(substr(part, 2 * j + 1, 100)) AS s FROM (SELECT doc_id, k, part, unnest(range(0, least(256, len(part) // 2 - 49))) AS j FROM c)),
f AS (SELECT s, min(doc_id) AS first_doc FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN f USING (s) WHERE f.first_doc < w.doc_id),
runs AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit),
part AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, g),
edge AS (SELECT doc_id, a, b, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM part),
span AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (
  SELECT *, sum(CASE WHEN a > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM edge) GROUP BY doc_id, k),
gap AS (SELECT doc_id, list({'a': a, 'b': b} ORDER BY a) AS s, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT n.doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN s IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(s) + 1), lambda k:
    substr(h, CASE WHEN k = 0 THEN 1 ELSE 2 * s[k].b + 1 END,
      2 * (CASE WHEN k = len(s) THEN n_bytes ELSE s[k + 1].a END - CASE WHEN k = 0 THEN 0 ELSE s[k].b END))), '') END)) AS kept_sha256
FROM n LEFT JOIN gap USING (doc_id)"""

WORD_REPEATS = rf"""
WITH d AS (SELECT doc_id, {SPACED.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first_doc FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN f USING (s) WHERE f.first_doc < g.doc_id) GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  CASE WHEN ps IS NULL THEN w ELSE list_transform(list_sort(list_where(range(1, len(w) + 1), list_transform(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)))), lambda i: w[i]) END AS k
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""


def license_scan() -> str:
    from threadspark.llm.license import PERCENT, PHRASES, TEMPLATES

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    notices = ", ".join(f"({k}, {quote(label)}, {quote(text)})" for k, (label, text) in enumerate(TEMPLATES))
    starts = {
        label: "list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = {quote(x)}" for k, x in enumerate(p)) + ")"
        for p, label in PHRASES.items()
    }
    found = ", ".join(f"{v} AS \"at_{k}\"" for k, v in starts.items())
    every = "list_concat(" + ", ".join(f'"at_{k}"' for k in list(starts)[:2]) + ")"
    for k in list(starts)[2:]:
        every = f'list_concat({every}, "at_{k}")'
    own = "list_filter([" + ", ".join(f"CASE WHEN len(\"at_{k}\") > 0 THEN {quote(k)} END" for k in starts) + "], lambda x: x IS NOT NULL)"
    return rf"""
WITH notice(k, label, text) AS (VALUES {notices}),
template AS (SELECT k, label, list_distinct({PLAIN.format(LOWER)}) AS s FROM notice),
doc AS (SELECT doc_id, {LOWER} AS t, {PLAIN.format(LOWER)} AS w FROM documents),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM doc),
block AS (SELECT doc_id, list_distinct({PLAIN.format("l")}) AS b FROM line),
hit AS (SELECT doc_id, label, len(list_intersect(s, b)) / len(s) AS c FROM block, template WHERE 100 * len(list_intersect(s, b)) >= {PERCENT} * len(s)),
best AS (SELECT doc_id, max(c) AS c, list(label) AS labels FROM hit GROUP BY doc_id),
base AS (SELECT doc_id, len(w) AS n_words, {found} FROM doc),
pos AS (SELECT doc_id, n_words, {every} AS places, {own} AS own FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) - 1 AS BIGINT) AS first_word,
  CAST(list_max(places) - 1 AS BIGINT) AS last_word, array_to_string(list_sort(own), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(own, coalesce(labels, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM pos LEFT JOIN best USING (doc_id)"""


def url_templates(levels: int = 8) -> str:
    """The operator's rule with its levels written out, for paths of up to ``levels`` segments."""
    from threadspark.llm.urltree import MANY_CHILDREN, MIN_PURITY, RULES, SMOOTHING, Z2

    fits, acts = "NULL", "NULL"
    for act, rule in sorted(RULES, key=lambda r: len(r[1])):
        h, p = rule.split("/", 1)
        test = f"((host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '/{p}'))"
        fits, acts = f"CASE WHEN {test} THEN '{rule}' ELSE {fits} END", f"CASE WHEN {test} THEN '{act}' ELSE {acts} END"
    steps, last = [], "t0"
    for k in range(levels + 1):
        steps.append(f"""
s{k} AS (SELECT *, coalesce(segs[{k + 1}], '') AS seg FROM {last}),
k{k} AS (SELECT host, template, seg, sum(n) AS kn, sum(lab) AS kl, sum(good) AS kg FROM s{k} GROUP BY ALL),
n{k} AS (SELECT *, count(*) OVER h AS kids, sum(CASE WHEN kn < 2 THEN 1 ELSE 0 END) OVER h AS few, sum(kl) OVER h AS nl, sum(kg) OVER h AS ng FROM k{k} WINDOW h AS (PARTITION BY host, template)),
v{k} AS (SELECT *, kg / nullif(kl, 0) - (ng - kg) / nullif(nl - kl, 0) AS dif, ng / nullif(nl, 0) AS p FROM n{k}),
m{k} AS (SELECT host, template, seg, template || CASE WHEN seg = '' THEN '' WHEN kids > 1 AND ((kn < 2 AND few > {MANY_CHILDREN})
  OR coalesce(dif * dif <= {Z2}::DOUBLE * p * (1 - p) * (1 / nullif(kl, 0) + 1 / nullif(nl - kl, 0)), true)) THEN '/*' ELSE '/' || seg END AS nxt FROM v{k}),
t{k + 1} AS (SELECT host, shape, segs, n, lab, good, nxt AS template FROM s{k} JOIN m{k} USING (host, template, seg))""")
        last = f"t{k + 1}"
    return rf"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, len(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
sg AS (SELECT *, list_filter(string_split(regexp_replace(path, '[0-9]+', '<n>', 'g'), '/'), lambda x: x <> '') AS ss FROM hp),
page AS (SELECT page_id, host, path, array_to_string(ss, '/') AS shape FROM sg),
lab AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels
  WHERE quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
shapes AS (SELECT host, shape, count(*) AS n, count(good) AS lab, coalesce(sum(good), 0) AS good FROM page LEFT JOIN lab ON lab.doc_id = page.page_id GROUP BY ALL),
t0 AS (SELECT host, shape, string_split(shape, '/') AS segs, n, lab, good, '' AS template FROM shapes),{','.join(steps)},
prior AS (SELECT coalesce(sum(good) / nullif(sum(lab), 0), 1.0) AS p FROM shapes),
pure AS (SELECT host, template, (sum(good) + {SMOOTHING}::DOUBLE * any_value(p)) / (sum(lab) + {SMOOTHING}::DOUBLE) AS purity FROM {last}, prior GROUP BY host, template)
SELECT page_id, host, path, {fits} AS rule, coalesce({acts}, CASE WHEN purity < {MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM page JOIN {last} USING (host, shape) JOIN pure USING (host, template)"""


#: CRC-32 bit by bit: a byte enters, then eight shifts (marked -1) follow.
CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, len(hex(encode({0}))) // 2), "
    "lambda i: list_prepend(('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))), "
    "lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT)"
)


def merkle_manifest(heights: tuple[int, int] = (6, 3)) -> str:
    """Trees level by level, up to 8**6 leaves a language and 8**3 languages."""
    part = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = []

    def tree(name: str, key: str, height: int) -> None:
        for k in range(height):
            steps.append(f"""
{name}g{k} AS (SELECT {key}, slot // 8 AS up, list(h ORDER BY slot) AS hs, any_value(n) > 1 AS more FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {name}{k}) GROUP BY ALL),
{name}{k + 1} AS (SELECT {key}, up AS slot, CASE WHEN more THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}g{k})""")

    def climb(source: str, name: str, key: str, height: int) -> str:
        for k in range(height):
            at = f"(d.slot // {8**k})"
            before, after = f"array_to_string(hs[1:{at} % 8], '')", f"array_to_string(hs[{at} % 8 + 2:8], '')"
            steps.append(f"""
{name}c{k} AS (SELECT d.* REPLACE (CASE WHEN more THEN d.proof || {before} || {after} ELSE d.proof END AS proof, CASE WHEN more THEN sha256({before} || d.f || {after}) ELSE d.f END AS f)
  FROM {source} d JOIN {name}g{k} g ON g.{key} IS NOT DISTINCT FROM d.{key} AND g.up = d.slot // {8 ** (k + 1)})""")
            source = f"{name}c{k}"
        return source

    tree("t", "lang", heights[0])
    steps.append(f"""
r0 AS (SELECT 0 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS slot, h FROM t{heights[0]})""")
    tree("r", "one", heights[1])
    low = climb("d0", "t", "lang", heights[0])
    steps.append(f"""
u0 AS (SELECT d.* REPLACE (r0.slot AS slot), 0 AS one, r0.h AS subroot FROM {low} d JOIN r0 ON r0.lang IS NOT DISTINCT FROM d.lang)""")
    top = climb("u0", "r", "one", heights[1])
    return rf"""
WITH l AS (SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN {CRC32.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS f FROM documents),
d0 AS (SELECT doc_id, lang, leaf, f, '' AS proof, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot FROM l),
t0 AS (SELECT lang, slot, leaf AS h FROM d0),{",".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM {top}, (SELECT h AS root FROM r{heights[1]})"""


def importance(buckets: int = 10_000) -> str:
    runs = "list_concat(w, " + ", ".join(
        f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))" for k in (2, 3)
    ) + ")"
    return rf"""
WITH d AS (SELECT doc_id, {PLAIN.format(LOWER)} AS w FROM documents),
df AS (SELECT doc_id, unnest({runs}) AS f FROM d),
bf AS (SELECT unnest({runs}) AS f FROM (SELECT {PLAIN.format(LOWER)} AS w FROM benchmark)),
b AS (SELECT f, {CRC32.format("f")} % {buckets} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
s AS (SELECT bucket, count(*) AS s FROM df JOIN b USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN b USING (f) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM df) AS all_s, (SELECT count(*) FROM bf) AS all_t),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (all_s + {buckets}) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (all_t + {buckets}) AS DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range({buckets})) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), total),
weight AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM df JOIN b USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
score AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS score
  FROM d LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM score)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN able AND place <= 5 * n // 100 THEN CAST(place AS BIGINT) END AS rank FROM ranked"""
