"""Personal data: patterns find protected entities, corpus co-occurrence finds terms that reveal them.

Emails, addresses, cards and phone numbers are the protected entities. A word is seen with
a target, one entity (its value) or a kind of entity, in two ways: place by place, when it
is one of the ``CONTEXT`` words before or after such an entity (words of entities are skipped,
line breaks are not a border), and document by document, when it stands anywhere outside the
entities of a document that holds the target. A word reveals a target when in
either way it is seen with it at least ``MIN_SEEN`` times, in at least ``MIN_SHARE`` of all its
occurrences (or documents), and with at least ``MIN_BITS`` bits of pointwise mutual information.
Those words are spans of kind "term" at all their occurrences outside entities, in all documents, with
entities or without. ``sanitise`` replaces entities by their kind and generalises
(words with digits: digits masked) or removes (others) the terms.

Counts and candidate words are DataFrames joined on the word. A task is handed a set
of words, to count or to find, only when that set was counted and found at most ``BROADCAST_TERMS``;
beyond that every word is shuffled, with its count or its places.

Edge cases: null or empty texts have no spans; repeated rows each count and all get the
same spans; null ids are kept; ties sort by start, then kind; very long texts and runs take time in
proportion to their length; an empty table gives an empty result;
other columns are carried by ``sanitise``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from threadspark.llm.common import as_rows
from threadspark.session import materialize

KINDS = ["email", "ip", "card", "phone", "term"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a match can always begin where its run of digits does
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
DIGIT = re.compile(r"[0-9]")

CONTEXT = 5
MIN_SEEN, MIN_SHARE, MIN_BITS = 3, 0.5, 3.0
BROADCAST_TERMS = 200_000

#: Bytes outside words become blanks; A-Z are lower-cased.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, widened from each ``@`` in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        if at > last and text[at - 1] in LOCAL and (m := DOMAIN.match(text, at + 1)):
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            last = m.end()
            out.append((start, last))
        at = text.find("@", at + 1)
    return out


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of every base match, by start, then kind."""
    out = []
    if "@" in text:
        out += [(a, b, 0) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def outer_words(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of every word that shares no place with an entity."""
    borders: list[int] = []  # starts and ends of the entities, overlapping ones as one
    for s, e, _ in sorted(found):
        if borders and s < borders[-1]:
            borders[-1] = max(borders[-1], e)
        else:
            borders += [s, e]
    words = ((m.start(), m.end()) for m in TERM.finditer(text))
    return [(a, b) for a, b in words if (k := bisect_right(borders, a)) % 2 == 0 and (k == len(borders) or borders[k] >= b)]


def context_terms(text: str, found: list[tuple[int, int, int]], outer: list[tuple[int, int]], width: int = CONTEXT) -> list[tuple[bytes, int, int]]:
    """(term, kind, value hash) of the ``width`` words outside entities before and after each entity."""
    starts = [a for a, _ in outer]
    out = []
    for start, end, kind in found:
        k = bisect_left(starts, start)
        out += [(text[a:b].encode().lower(), kind, value_hash(text[start:end])) for a, b in outer[max(0, k - width) : k + width] if b - a > 1]
    return out


def value_hash(value: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(value.lower()) - 2**63


def term_spans(text: str, found: list[tuple[int, int, int]], known: frozenset) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of every known term outside the entities."""
    if known.isdisjoint(text.encode().translate(_FOLD).split()):
        return []
    return [(a, b, KINDS.index("term")) for a, b in outer_words(text, found) if b - a > 1 and text[a:b].encode().lower() in known]


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
_TARGET = [("kind", pa.int32()), ("value", pa.int64())]
_NEAR = pa.struct([("term", pa.binary()), *_TARGET])
_SCHEMA = (
    "doc_id long, key binary, spans array<struct<start: long, end: long, kind: int>>, "
    "near array<struct<term: binary, kind: int, value: long>>, holds array<struct<kind: int, value: long>>, words array<binary>"
)


def _span_rows(spans: list) -> list[dict]:
    return [dict(zip(("start", "end", "kind"), x)) for x in spans]


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(t).alias("key"), t.alias("t"))


def find_entities(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, key (hash of the text), entity spans, the words near them, the distinct entities, and the distinct words outside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, near, holds, words = [], [], [], []
            for t in batch.column("t").to_pylist():
                found = entities(t)
                outer = outer_words(t, found) if found else []
                spans.append(_span_rows(found))
                near.append([dict(zip(("term", "kind", "value"), x)) for x in context_terms(t, found, outer)])
                holds.append([{"kind": k, "value": v} for k, v in {(k, value_hash(t[s:e])) for s, e, k in found}])
                words.append(list({t[a:b].encode().lower() for a, b in outer if b - a > 1}))
            made = (spans, pa.list_(_SPAN)), (near, pa.list_(_NEAR)), (holds, pa.list_(pa.struct(_TARGET))), (words, pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), *[pa.array(x, kind) for x, kind in made]],
                ["doc_id", "key", "spans", "near", "holds", "words"],
            )

    return _texts(docs, id_col, text).mapInArrow(run, _SCHEMA)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _known(terms: DataFrame):
    """The terms as a broadcast set, of None when there are too many of them."""
    few = terms.count() <= BROADCAST_TERMS
    return terms.sparkSession.sparkContext.broadcast(frozenset(bytes(r[0]) for r in terms.collect()) if few else None)


def term_counts(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(term, n, docs): occurrences over all documents of the wanted terms, and documents they stand in; the empty term counts all words and documents."""
    known = _known(wanted)

    def rows(seen: Counter, held: Counter) -> pa.RecordBatch:
        counts = [list(seen), list(seen.values()), [held[w] for w in seen]]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(counts, (pa.binary(), pa.int64(), pa.int64()))], ["term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, total, read, ask = Counter(), Counter(), 0, 0, known.value
        for batch in batches:
            for t in batch.column("t").to_pylist():
                words = (t or "").encode().translate(_FOLD).split()
                total, read = total + len(words), read + 1
                hits = words if ask is None else [w for w in words if w in ask]
                seen.update(hits)
                held.update(set(hits))
            if len(seen) > 500_000:
                yield rows(seen, held)
                seen, held = Counter(), Counter()
        seen[b""], held[b""] = total, read
        yield rows(seen, held)

    counts = docs.select(F.col(text).alias("t")).mapInArrow(run, "term binary, n long, docs long")
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def revealing_terms(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(term, target, share, bits) of the words that reveal a kind (target "0".."3") or one entity (target "kind:value").

    A pair may come twice, found place by place and document by document.
    """
    places = materialize(_contexts(found).groupBy("term", "target").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= MIN_SEEN))
    around = _contexts(found).groupBy("target").agg(F.count(F.lit(1)).alias("ct"))
    holders, whole = _holders(found)
    whole = materialize(whole)
    counts = materialize(term_counts(docs, places.select("term").union(whole.select("term")).distinct(), text))
    by_place = _revealing(places, around, counts.select("term", "n"))
    return by_place.union(_revealing(whole, holders, counts.select("term", F.col("docs").alias("n"))))


def _revealing(seen: DataFrame, targets: DataFrame, counts: DataFrame) -> DataFrame:
    total = counts.filter(F.length("term") == 0).select(F.col("n").alias("total"))
    bits = F.log2(F.col("c") * F.col("total") / (F.col("n") * F.col("ct")))
    return (
        seen.join(counts, "term").join(targets, "target").join(F.broadcast(total))  # one row
        .select("term", "target", (F.col("c") / F.col("n")).alias("share"), bits.alias("bits"))
        .filter((F.col("share") >= MIN_SHARE) & (F.col("bits") >= MIN_BITS))
    )


def _targets(kind: Column, value: Column) -> Column:
    kind = kind.cast("string")
    return F.array(kind, F.concat(kind, F.lit(":"), value.cast("string")))


def _contexts(found: DataFrame) -> DataFrame:
    near = found.select("key", F.explode("near").alias("w")).select("key", "w.*")
    return near.withColumn("target", F.explode(_targets(F.col("kind"), F.col("value"))))


def _holders(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target, ct): documents that hold it, and (term, target, c): those with the term too. Targets held and pairs seen less than ``MIN_SEEN`` times are out, as they reveal nothing."""
    texts = materialize(  # equal texts once
        found.filter(F.size("spans") > 0).groupBy("key")
        .agg(F.count(F.lit(1)).alias("copies"), F.first("holds").alias("holds"), F.first("words").alias("words"))
    )
    targets = F.array_distinct(F.flatten(F.transform("holds", lambda h: _targets(h["kind"], h["value"]))))
    held = texts.select("key", "copies", F.explode(targets).alias("target"))
    holders = materialize(held.groupBy("target").agg(F.sum("copies").alias("ct")).filter(F.col("ct") >= MIN_SEEN))
    own = held.join(holders.select("target"), "target", "left_semi").groupBy("key").agg(F.collect_list("target").alias("targets"))
    pairs = texts.join(own, "key").select("copies", "targets", F.explode("words").alias("term")).select("term", "copies", F.explode("targets").alias("target"))
    return holders, pairs.groupBy("term", "target").agg(F.sum("copies").alias("c")).filter(F.col("c") >= MIN_SEEN)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, key, base (entity spans) and spans (with the revealing terms), both sorted."""
    found = materialize(find_entities(docs, id_col, text))
    reveal = materialize(revealing_terms(docs, found, text).select("term").distinct())
    known = _known(reveal)
    if known.value is None:
        return _joined_spans(found, _texts(docs, id_col, text), reveal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for t in batch.column("t").to_pylist():
                own = entities(t)
                base.append(_span_rows(own))
                spans.append(_span_rows(sorted(own + term_spans(t, own, known.value), key=lambda x: (x[0], x[2], x[1]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(base, pa.list_(_SPAN)), pa.array(spans, pa.list_(_SPAN))],
                ["doc_id", "key", "base", "spans"],
            )

    spans = "array<struct<start: long, end: long, kind: int>>"
    return _texts(docs, id_col, text).mapInArrow(run, f"doc_id long, key binary, base {spans}, spans {spans}")


def _joined_spans(found: DataFrame, texts: DataFrame, reveal: DataFrame) -> DataFrame:
    """``personal_data`` when the terms are too many for a task: every word's places are joined with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, terms, at = [], [], []
            for key, t in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist()):
                own: dict[bytes, list] = {}
                for a, b in outer_words(t, entities(t)):
                    if b - a > 1:
                        own.setdefault(t[a:b].encode().lower(), []).append({"start": a, "end": b, "kind": KINDS.index("term")})
                keys += [key] * len(own)
                terms += own.keys()
                at += own.values()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(terms, pa.binary()), pa.array(at, pa.list_(_SPAN))], ["key", "term", "at"])

    places = texts.select("key", "t").mapInArrow(run, "key binary, term binary, at array<struct<start: long, end: long, kind: int>>")
    flagged = places.join(reveal, "term", "left_semi").groupBy("key").agg(F.flatten(F.collect_set("at")).alias("terms"))
    return found.join(flagged, "key", "left").select(
        "doc_id", "key", F.col("spans").alias("base"),
        F.array_sort(F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.concat("spans", "terms")), _by_start).alias("spans"),
    )


def _by_start(a: Column, b: Column) -> Column:
    x, y = F.struct(a["start"], a["kind"], a["end"]), F.struct(b["start"], b["kind"], b["end"])
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: str, spans: list) -> str:
    """Entities become <KIND>; terms with digits are masked, others removed. Overlapping spans go as one, under the first one's mark."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            piece = text[s["start"] : s["end"]]
            mark = f"<{KINDS[s['kind']].upper()}>" if s["kind"] < 4 else re.sub("[0-9]", "#", piece) if DIGIT.search(piece) else ""
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data replaced in ``text``; all other columns and clean texts as they were.

    The texts are replaced where they are read; only when the revealing terms are too many for a task are they joined with their spans.
    """
    texts = docs.select(F.lit(None).cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    found = materialize(find_entities(texts, "id", "t"))
    reveal = materialize(revealing_terms(texts, found, "t").select("term").distinct())
    known = _known(reveal)
    held = as_rows(docs)
    if known.value is not None:

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = []
                for t in batch.column("t").to_pylist():
                    own = entities(t) if t else []
                    spans = own + term_spans(t, own, known.value) if t else []
                    new.append(replaced(t, _span_rows(sorted(spans, key=lambda x: (x[0], x[2], x[1])))) if spans else t)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], ["row", "t"])

        schema = StructType([StructField("row", docs.schema), StructField("t", StringType())])
        done = held.select("row", F.col(f"row.`{text}`").alias("t")).mapInArrow(clean, schema)
        return done.withColumn("row", F.col("row").withField(f"`{text}`", F.col("t"))).select("row.*")
    spans = _joined_spans(found, _texts(texts, "id", "t"), reveal).filter(F.size("spans") > 0).select("key", "spans").dropDuplicates(["key"])

    @F.arrow_udf("string")
    def put(t: pa.Array, s: pa.Array) -> pa.Array:
        return pa.array([replaced(x, y) if y else x for x, y in zip(t.to_pylist(), s.to_pylist())], pa.string())

    held = held.withColumn("key", text_key(F.coalesce(F.col(f"row.`{text}`"), F.lit("")))).join(spans, "key", "left")
    return held.withColumn("row", F.col("row").withField(f"`{text}`", put(F.col(f"row.`{text}`"), F.col("spans")))).select("row.*")
