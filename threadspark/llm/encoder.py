"""Fast exact encoding with the tokenizers library: whole words are encoded once per Python worker.

Both public tokenizers cut a text at white space before they merge, so the ids of
a text are the ids of its white-space pieces in order. Both also cut between an ASCII letter and
ASCII punctuation, so a piece ends there, too. A batch is cut where it lies, by the class of its bytes, and
dictionary-encoded with Arrow; its distinct pieces are looked up in a bounded table of the
worker, and only unknown ones reach the tokenizer, in byte mode many joined to one text.
A text whose cut would differ from the tokenizer's (an added token such as an end mark written
in the text, runs of white space in byte mode) is encoded whole.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PORTION = 2_000_000
JOIN = 64

_ENCODERS: dict[tuple[str, str], "WordEncoder"] = {}
_BLANK, _LETTER, _SIGN = 1, 2, 3


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes(blanks: bytes) -> np.ndarray:
    """Class of every byte value; bytes that end no piece have none."""
    got = np.zeros(256, np.uint8)
    for b in range(128):
        c = chr(b)
        got[b] = _BLANK if b in blanks else _LETTER if c.isalpha() else _SIGN if c.isprintable() and c != " " and not c.isalnum() else 0
    return got


class _Pieces:
    """Ids of pieces, by slot. ``loose``: pieces that end in white space."""

    def __init__(self):
        self.slots: dict[bytes, int] = {}
        self.ids, self.ends, self.loose = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, bool)

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """Slots, -1 for unknown pieces."""
        return np.fromiter(map(self.slots.get, pieces, repeat(-1)), np.int64, len(pieces))

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slots one after the other, and where each slot's ids end."""
        first = self.ends[slots]
        n = self.ends[slots + 1] - first
        ends = np.cumsum(n)
        at = np.repeat(first - (ends - n), n)
        at += np.arange(len(at))
        return self.ids[at], ends

    def add(self, pieces: list[bytes], ids: np.ndarray, ends: np.ndarray, loose: np.ndarray) -> np.ndarray:
        """Slots of new pieces."""
        slots = np.arange(len(self.loose), len(self.loose) + len(pieces))
        self.slots.update(zip(pieces, slots.tolist()))
        self.ends = np.concatenate((self.ends, ends + len(self.ids)))
        self.ids, self.loose = np.concatenate((self.ids, ids)), np.concatenate((self.loose, loose))
        return slots


class WordEncoder:
    """``mode`` "byte": pieces keep their leading blank or newline; "word": lower-cased, white space counts as one blank.

    ``most``: pieces remembered in each of two generations, of eight ids on average at most.
    """

    def __init__(self, path: str, mode: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        added = {k: t.content for k, t in self.plain.get_added_tokens_decoder().items()}
        self.added = [t.lower() for t in added.values()]
        self.mode, self.most, self.new, self.old = mode, most, _Pieces(), _Pieces()
        self.classes = _classes(b" \n" if mode == "byte" else b" \t\n\x0b\x0c\r")
        if mode == "byte":  # a byte-level token is written with one character per byte
            vocabulary = self.plain.get_vocab(with_added_tokens=False)
            self.width = np.zeros(max([*vocabulary.values(), *added]) + 1, np.int64)
            self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
            self.width[list(added)] = [len(t.encode()) for t in added.values()]
        else:
            self.plainer = np.arange(256, dtype=np.uint8)
            self.plainer[ord("A") : ord("Z") + 1] += ord("a") - ord("A")
            self.plainer[self.classes == _BLANK] = ord(" ")

    def whole(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and per text where its pieces end."""
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        kind = self.classes[data]
        start = np.append(kind == _BLANK, True)
        start[1:-1] |= (kind[:-1] == _LETTER) & (kind[1:] == _SIGN)
        start[at] = True
        starts = np.flatnonzero(start)
        if self.mode == "word":
            data = self.plainer[data]
        flat = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)])
        return flat, np.searchsorted(starts, at[1:])

    def _lookup(self, pieces: list[bytes]) -> np.ndarray:
        """Slots of distinct pieces in ``new``."""
        if len(self.new.loose) > self.most or len(self.new.ids) > 8 * self.most:
            self.old, self.new = self.new, _Pieces()
        slots = self.new.find(pieces)
        lost = np.flatnonzero(slots < 0)
        if len(lost):
            before = self.old.find([pieces[k] for k in lost.tolist()])
            kept, ask = lost[before >= 0], lost[before < 0]
            before = before[before >= 0]
            slots[kept] = self.new.add([pieces[k] for k in kept.tolist()], *self.old.take(before), self.old.loose[before])
            names = [pieces[k] for k in ask.tolist()]
            texts = [p.decode() for p in names]
            loose = np.fromiter((t[-1:].isspace() for t in texts), bool, len(texts))
            slots[ask] = self.new.add(names, *self._ask(texts, loose), loose)
        return slots

    def _ask(self, texts: list[str], loose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of unknown pieces, and where each piece's ids end."""
        if self.mode == "byte":
            joined = np.fromiter((t[0] in " \n" for t in texts), bool, len(texts)) & ~loose
        else:
            joined = np.zeros(len(texts), bool)
        some, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
        got: list = [None] * len(texts)
        # After a piece that does not end in white space the tokenizer cuts before a blank or newline, as it does within a text.
        runs = [some[a : a + JOIN].tolist() for a in range(0, len(some), JOIN)]
        for run, e in zip(runs, self.plain.encode_batch_fast(["".join([texts[k] for k in run]) for run in runs], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            reached = np.cumsum(self.width[ids])  # bytes up to each id's end
            wanted = np.cumsum([len(texts[k].encode()) for k in run])
            ends = np.searchsorted(reached, wanted)
            if not len(ids) or reached[-1] != wanted[-1] or (reached[ends] != wanted).any():
                alone = np.append(alone, run)
                continue
            for k, a, b in zip(run, [0, *(ends[:-1] + 1).tolist()], (ends + 1).tolist()):
                got[k] = ids[a:b]
        for k, e in zip(alone.tolist(), self.plain.encode_batch_fast([texts[k] for k in alone.tolist()], add_special_tokens=False)):
            got[k] = np.array(e.ids, dtype="<u4")
        ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
        return np.concatenate([np.zeros(0, "<u4"), *got]), ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and, per text, where its ids end. Null texts are empty.

        About ``PORTION`` bytes are taken at a time: the arrays of a portion are some 20 times its text.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        ids, ends, a, done = [], [], 0, 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + PORTION, "right")))
            some, end = self._encode(texts.slice(a, b - a))
            ids.append(some)
            ends.append(end + done)
            a, done = b, done + len(some)
        if not ids:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(ends)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, ends = self._cut(texts)
        codes = flat.dictionary_encode()
        slots = self._lookup(codes.dictionary.to_pylist())[codes.indices.to_numpy()]
        got, total = self.new.take(slots)
        doc_end = np.concatenate(([0], total))[ends]
        odd = self._odd(texts, slots, ends)
        if not len(odd):
            return got, doc_end
        starts = np.concatenate(([0], doc_end[:-1]))
        fixed = {int(d): np.frombuffer(self.whole(texts[int(d)].as_py()), "<u4") for d in odd}
        chunks = [fixed.get(d, got[a:b]) for d, (a, b) in enumerate(zip(starts, doc_end))]
        return np.concatenate(chunks), np.cumsum([len(c) for c in chunks])

    def _odd(self, texts: pa.Array, slots: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Texts to encode whole: those with an added token of the vocabulary, in any case; in byte mode also
        those where a piece that ends in white space hides a run of white space."""
        lower = pc.ascii_lower(texts)
        odd = [np.flatnonzero(pc.match_substring(lower, t).to_numpy(zero_copy_only=False)) for t in self.added]
        if self.mode == "byte":
            odd.append(np.searchsorted(ends, np.flatnonzero(self.new.loose[slots]), "right"))
        return np.unique(np.concatenate(odd)) if odd else np.zeros(0, np.int64)


def encoder(path: str, mode: str) -> WordEncoder:
    """One encoder per file and Python worker."""
    key = (path, mode)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, mode)
    return _ENCODERS[key]
