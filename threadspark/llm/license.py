"""License scans: exact set-similarity join of text blocks with license templates.

A block is a line or, for notices that wrap, a run over neighbouring lines: as many consecutive words
as the template has, within lines that hold words and are not parted by one without any. A template is found in a block when at least ``percent`` % of the
template's distinct words occur in it (containment). Words are ordered by how many
blocks of the whole corpus hold them, rare first; a block is a candidate only when
it shares a word with a template's prefix (prefix filter), has enough words (length
filter) and enough words left behind the shared positions (positional filter).
Every candidate is verified by the exact intersection, so the join is lossless.

Templates are a parameter, at most ``MOST_TEMPLATE_WORDS`` words in all; their index
is part of the task. Blocks never leave the task that reads them: only one count
per template word and task is shuffled, so neither hot sources nor repeated lines
gather anywhere.

Words: A-Z lower-cased, runs of digits, a-z and non-ASCII characters.

Edge cases: null or empty texts have no words and no match; repeated rows are scanned
one by one; ids may be null; other columns are not read; an empty table gives an empty result; equally
frequent words are ordered by the word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases: consecutive words -> label.
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

#: Short public license notices: (label, notice). Fixed values.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
PERCENT = 80
MOST_TEMPLATE_WORDS = 100_000

#: Bytes that are not part of a word become blanks, newlines stay; A-Z are lower-cased.
_FOLD = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c == 10 else 32
    for c in range(256)
)


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "labels array<string>, score double, blocks array<struct<line: long, label: string, containment: double>>, "
    "wrapped array<struct<line: long, last: long, label: string, containment: double>>"
)
_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks", "wrapped"]
_BLOCK = pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])
_WRAPPED = pa.struct([("line", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])
_TYPES = [*[pa.int64()] * 4, *[pa.list_(pa.string())] * 2, pa.float64(), pa.list_(_BLOCK), pa.list_(_WRAPPED)]


def fold(text: str | None) -> bytes:
    return (text or "").encode().translate(_FOLD)


class TemplateIndex:
    """Prefix index of the templates under one global word order."""

    def __init__(self, templates, percent: int, frequency: dict[bytes, int]):
        self.labels = [label for label, _ in templates]
        self.sets = [frozenset(fold(t).split()) for _, t in templates]
        self.lengths = [len(fold(t).split()) for _, t in templates]
        if not all(self.sets):
            raise ValueError("a template has no words")
        vocabulary = sorted(set().union(*self.sets), key=lambda w: (frequency.get(w, 0), w))
        if len(vocabulary) > MOST_TEMPLATE_WORDS:
            raise ValueError(f"templates hold over {MOST_TEMPLATE_WORDS} words")
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.need = [-(-percent * len(s) // 100) for s in self.sets]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.sets):
            for i, w in enumerate(sorted(words, key=self.rank.__getitem__)[: len(words) - self.need[k] + 1]):
                self.prefix.setdefault(w, []).append((k, i))
        self.vocabulary, self.starters = frozenset(vocabulary), frozenset(self.prefix)

    def matches(self, words: set[bytes]) -> list[tuple[int, int]]:
        """(template, overlap) of every template contained in a block's word set."""
        if self.starters.isdisjoint(words):
            return []
        own = sorted(words & self.vocabulary, key=self.rank.__getitem__)
        candidates = set()
        for j, w in enumerate(own):
            for k, i in self.prefix.get(w, ()):
                if len(own) >= self.need[k] and 1 + min(len(self.sets[k]) - i - 1, len(own) - j - 1) + min(i, j) >= self.need[k]:
                    candidates.add(k)
        return [(k, n) for k in sorted(candidates) if (n := len(self.sets[k].intersection(own))) >= self.need[k]]

    def wrapped_matches(self, lines: list[tuple[int, list[bytes]]]) -> list[tuple[int, int, int, int]]:
        """(first line, last line, template, overlap) of every template contained in a run over neighbouring lines.

        Overlapping runs of a template count as one, with its best run. ``lines``: number and words of the lines of a paragraph.
        """
        words = [w for _, own in lines for w in own]
        if len(lines) < 2 or self.starters.isdisjoint(words):
            return []
        of = [number for number, own in lines for _ in own]
        near: dict[int, list[int]] = {}  # a run that holds enough of a template holds a word of its prefix
        for at, w in enumerate(words):
            for k, _ in self.prefix.get(w, ()):
                near.setdefault(k, []).append(at)
        out = []
        for k, places in sorted(near.items()):
            size, known = min(self.lengths[k], len(words)), self.sets[k]
            if len(known.intersection(words)) < self.need[k]:
                continue
            best, start, reached = None, 0, -1
            held: Counter = Counter()
            for at in places:
                first, final = max(at - size + 1, reached + 1, 0), min(at, len(words) - size)
                if first > final:
                    continue
                if first != reached + 1 or reached < 0:
                    held = Counter(w for w in words[first : first + size] if w in known)
                else:
                    self._slide(held, words, first, size, known)
                for i in range(first, final + 1):
                    if i > first:
                        self._slide(held, words, i, size, known)
                    if len(held) >= self.need[k] and of[i] != of[i + size - 1]:
                        if best is not None and i >= start + size:
                            out.append(best)
                            best = None
                        if best is None or len(held) > best[3]:
                            best, start = (of[i], of[i + size - 1], k, len(held)), i
                reached = final
            if best is not None:
                out.append(best)
        return out

    @staticmethod
    def _slide(held: Counter, words: list[bytes], i: int, size: int, known: frozenset) -> None:
        """From the run before ``i`` to the run at ``i``."""
        if (gone := words[i - 1]) in known:
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
        if (new := words[i + size - 1]) in known:
            held[new] += 1


def paragraphs(lines: list[list[bytes]]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Neighbouring lines with words, numbered."""
    own: list[tuple[int, list[bytes]]] = []
    for number, words in enumerate(lines):
        if words:
            own.append((number, words))
        elif own:
            yield own
            own = []
    if own:
        yield own


def block_frequencies(docs: DataFrame, vocabulary: list[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many blocks of the whole corpus each template word occurs."""
    known = frozenset(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch["t"]:
                for line in fold(t).split(b"\n"):
                    if not known.isdisjoint(words := line.split()):
                        seen.update(known.intersection(words))
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    rows = docs.select(F.col(text).alias("t")).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}  # at most one row for each template word


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """One row per document.

    doc_id, n_words, n_base (places of base phrases), first_word, last_word (smallest and
    largest start of one, else null), base_labels and labels (sorted, distinct), score
    (best containment found; 1 with a base phrase; 0 without any), blocks (line, label,
    containment of every match within a line), wrapped (line, last line, label, containment of every match over lines).
    """
    vocabulary = sorted(set().union(*[fold(t).split() for _, t in templates]))
    frequency = block_frequencies(docs, vocabulary, text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, percent, frequency)
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            for t in batch.column("t").to_pylist():
                folded, n, blocks = fold(t), 0, []
                lines = [line.split() for line in folded.split(b"\n")]
                for number, words in enumerate(lines):
                    n += len(words)
                    for k, hit in () if index.starters.isdisjoint(words) else index.matches(set(words)):
                        blocks.append({"line": number, "label": index.labels[k], "containment": hit / len(index.sets[k])})
                wrapped = [
                    {"line": a, "last": b, "label": index.labels[k], "containment": hit / len(index.sets[k])}
                    for part in paragraphs(lines) for a, b, k, hit in index.wrapped_matches(part)
                ]
                starts, base = phrase_starts(folded)
                labels = sorted(base | {b["label"] for b in blocks + wrapped})
                score = 1.0 if starts else max((b["containment"] for b in blocks + wrapped), default=0.0)
                for out, v in zip(rows, (n, len(starts), min(starts, default=None), max(starts, default=None), sorted(base), labels, score, blocks, wrapped)):
                    out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, rows, _TYPES)], _NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(scan, SCHEMA)


def phrase_starts(folded: bytes) -> tuple[list[int], set[str]]:
    """Starts (word numbers) of all base phrases, and the labels found."""
    if not any(p[-1].encode() in folded for p in PHRASES):
        return [], set()
    words, starts, labels = folded.split(), [], set()
    for phrase, label in PHRASES.items():
        p = [w.encode() for w in phrase]
        at = [i for i, w in enumerate(words) if w == p[0] and words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return starts, labels
