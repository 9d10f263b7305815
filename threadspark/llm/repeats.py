"""Repeated windows across documents: shared by the run-length and the FM-index operator.

1. Documents fall into buckets by hash; a bucket sends each shard its distinct anchor fingerprints.
2. A shard answers which fingerprints occur in two or more documents.
3. A bucket sends each shard the distinct segments behind those, with the smallest and
   largest id of the documents that hold them.
4. A shard indexes its distinct segments, streams them through the index and answers,
   per segment, which windows also start in a smaller document, and in which.
5. A bucket marks the covered symbols of its documents.

Between buckets and shards there is one row per pair, holding distinct values only: a
passage in a third of all documents is one entry of each bucket, so no group is
ever gathered whole. All steps are grouped Arrow functions on one shuffled copy of the
documents (reused), so a lost executor costs a recomputation and nothing else.

Edge cases: null or empty texts have no windows; a null id never counts as smaller and ranks after all
others or, on demand, has no smaller one; ids may be negative; rows with equal ids do not remove each other; repeated rows are answered each;
long texts stay in one bucket, long repetitions are cut into segments of at most two windows;
other columns are not read; an empty table gives an empty result. Segments are equal when their
128-bit hashes are, words inside a shard when their bytes are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadspark.llm.anchors import Segments, byte_grams, gather, prefix_hash, range_hash, shard_key, strong_hashes, super_windows, symbol_grams
from threadspark.llm.common import shuffle_parts

#: Buckets of documents and shards of anchors per shuffle partition. There is at most one row per pair, so
#: shards are few; a large shard is indexed in portions.
BUCKETS_PER_PARTITION = 4
SHARDS_PER_PARTITION = 1
FIRST_ID, LAST_ID = -(2**63), 2**63 - 1

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@dataclass
class Bucket:
    """Documents of a bucket as symbols: ``ends`` per document, symbols' place in ``data``."""

    data: np.ndarray
    ids: np.ndarray
    ends: np.ndarray
    begin: np.ndarray | None
    stop: np.ndarray | None
    segments: Segments

    def span(self, s: Segments, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte range of segments."""
        last = s.start + s.count + length - 1
        return (s.start, last) if self.begin is None else (self.begin[s.start], self.stop[last - 1])

    def hashes(self, s: Segments, length: int) -> np.ndarray:
        return strong_hashes(self.data, *self.span(s, length))

    def content(self, s: Segments, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of segments, one after the other (words each followed by white space), and their lengths."""
        a, b = self.span(s, length)
        n = b - a + (self.begin is not None)
        return gather(self.data, a, n), n


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every white-space separated word; data ends in white space."""
    space = _SPACE[data]
    before = np.concatenate(([True], space[:-1]))
    return np.flatnonzero(~space & before), np.flatnonzero(space & ~before)


def one_blank(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of ``data`` with one blank after each, their begins and ends: equal runs of words are equal bytes."""
    begin, stop = split_words(data)
    size = stop - begin
    first = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    letters = np.ones(len(out), bool)
    letters[first + size] = False
    out[letters] = data[~_SPACE[data]]
    return out, first, first + size


def word_symbols(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Words as 64-bit numbers for the choice of anchors; different words may share one."""
    sums, inverse = prefix_hash(data.astype(np.uint64))
    return range_hash(sums, inverse, begin, stop)


def word_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each distinct word of ``data`` (words with one blank after each) and where every word begins."""
    begin = np.concatenate(([0], np.flatnonzero(data == 32)[:-1] + 1)) if len(data) else np.zeros(0, np.int64)
    offsets = np.append(begin, len(data)).astype(np.int64)
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return held.dictionary_encode().indices.to_numpy().astype(np.int64), begin


def load(table: pa.Table, words: bool, length: int, gram: int, windows: bool = True) -> Bucket:
    texts = [(t or "").encode() for t in table.column("text").to_pylist()]
    ids = np.array([LAST_ID if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
    pad = b" " if words else b""
    data = np.frombuffer(pad.join(texts) + b" " * 32, np.uint8)
    ends = np.cumsum([len(t) + len(pad) for t in texts])
    begin = stop = None
    if words:
        ends = np.searchsorted(split_words(data)[0], ends)
        data, begin, stop = one_blank(data)
    none = np.zeros(0, np.int64)
    segments = Segments(none, none, none, none.astype(np.uint64))
    if windows:
        symbols = word_symbols(data, begin, stop) if words else None
        grams = (lambda a, b: symbol_grams(symbols, a, b, gram)) if words else (lambda a, b: byte_grams(data, a, b))
        segments = super_windows(grams, ends, length, gram)
    return Bucket(data, ids, ends, begin, stop, segments)


def turns(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before (the first one does)."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _by_shard(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) ranges of sorted shard keys."""
    shard = (keys >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else np.zeros(0, np.int64)
    return [(int(shard[a]), int(a), int(b)) for a, b in zip(cut, np.append(cut[1:], len(shard)))]


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, count: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=count * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def send_fingerprints(table: pa.Table, shards: int, words: bool, length: int, gram: int) -> pa.Table:
    """Step 1: (shard, bucket, fingerprints seen in one document, in several)."""
    bucket, names = table.column("bucket")[0].as_py(), ["shard", "bucket", "once", "many"]
    s = load(table, words, length, gram).segments
    keys, order = np.unique(shard_key(s.anchor, shards), return_inverse=True)
    low, high = np.full(len(keys), len(table), np.int64), np.full(len(keys), -1, np.int64)
    np.minimum.at(low, order, s.doc)
    np.maximum.at(high, order, s.doc)
    many, low32 = high > low, keys.astype(np.uint32)
    rows = [(p, bucket, low32[a:b][~many[a:b]].tobytes(), low32[a:b][many[a:b]].tobytes()) for p, a, b in _by_shard(keys)]
    return _table(rows, names, [pa.int32(), pa.int32(), pa.binary(), pa.binary()])


def answer_fingerprints(table: pa.Table) -> pa.Table:
    """Step 2: (bucket, shard, those of its fingerprints that occur in two or more documents)."""
    shard, buckets = table.column("shard")[0].as_py(), table.column("bucket").to_pylist()
    once = [np.frombuffer(x, np.uint32) for x in table.column("once").to_pylist()]
    many = [np.frombuffer(x, np.uint32) for x in table.column("many").to_pylist()]
    values = np.sort(np.concatenate(once))
    twice = np.unique(np.concatenate([values[1:][values[1:] == values[:-1]], *many]))
    rows = []
    for b, o, m in zip(buckets, once, many):
        own = np.concatenate((o, m))
        at = np.searchsorted(twice, own)
        at[at == len(twice)] = 0
        own = own[twice[at] == own] if len(twice) else own[:0]
        if len(own):
            rows.append((b, shard, own.tobytes()))
    return _table(rows, ["bucket", "shard", "prints"], [pa.int32(), pa.int32(), pa.binary()])


def send_segments(docs: pa.Table, answers: pa.Table, shards: int, words: bool, length: int, gram: int) -> pa.Table:
    """Step 3: (shard, bucket, distinct segments: anchor fingerprints, smallest and largest id, byte lengths, bytes; the last four compressed)."""
    names = ["shard", "bucket", "prints", "low", "high", "sizes", "content"]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    if not len(docs) or not len(answers):
        return _table([], names, kinds)
    number, bucket = docs.column("bucket")[0].as_py(), load(docs, words, length, gram)
    wanted = [np.frombuffer(p, np.uint32).astype(np.uint64) | np.uint64(s) << np.uint64(32) for s, p in zip(answers.column("shard").to_pylist(), answers.column("prints").to_pylist())]
    wanted = np.sort(np.concatenate(wanted))
    keys = shard_key(bucket.segments.anchor, shards)
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    chosen = np.flatnonzero(wanted[at] == keys)
    s, keys = bucket.segments.pick(chosen), keys[chosen]
    hashes, ids = bucket.hashes(s, length), bucket.ids[s.doc]
    order = np.lexsort((hashes[:, 1], hashes[:, 0], keys >> np.uint64(32)))
    new = np.flatnonzero(turns(hashes[:, 0][order]) | turns(hashes[:, 1][order]))
    low, high = np.minimum.reduceat(ids[order], new), np.maximum.reduceat(ids[order], new)
    first = order[new]
    s, keys = s.pick(first), keys[first]
    content, sizes = bucket.content(s, length)
    prints = keys.astype(np.uint32)
    stops = np.concatenate(([0], np.cumsum(sizes)))
    rows = [
        (p, number, prints[a:b].tobytes(), _pack(low[a:b]), _pack(high[a:b]), _pack(sizes[a:b].astype(np.int32)), _pack(content[stops[a] : stops[b]]))
        for p, a, b in _by_shard(keys)
    ]
    return _table(rows, names, kinds)


def answer_segments(table: pa.Table, index, words: bool, length: int) -> pa.Table:
    """Step 4: (bucket, hashes, from, to, owner): windows from..to of a segment also start in document ``owner``."""
    names, kinds = ["bucket", "hashes", "from", "to", "owner"], [pa.int32(), *[pa.binary()] * 4]
    read = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
    own = read("prints", np.uint32)
    unpacked = lambda c, t, counts: [_unpack(x, k, t) for x, k in zip(table.column(c).to_pylist(), counts)]
    low, high, sizes = (unpacked(c, t, map(len, own)) for c, t in (("low", np.int64), ("high", np.int64), ("sizes", np.int32)))
    content = unpacked("content", np.uint8, (int(x.sum(dtype=np.int64)) for x in sizes))
    prints, size, data = np.concatenate(own), np.concatenate(sizes).astype(np.int64), np.concatenate(content)
    at = np.cumsum(size) - size
    every = strong_hashes(data, at, at + size - int(words))
    order = np.lexsort((every[:, 1], every[:, 0], prints))
    new = turns(every[:, 0][order]) | turns(every[:, 1][order]) | turns(prints[order])
    first, back = order[new], np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    owners = np.minimum.reduceat(np.concatenate(low)[order], np.flatnonzero(new))
    begin = at[first]
    size, prints = size[first], prints[first]
    ids, owners = np.unique(owners, return_inverse=True)  # the index tells "no match" by -1, which an id may be
    seg, start, stop, owner = [], [], [], []
    for a, b in _portions(size, prints, index.portion):
        text = gather(data, begin[a:b], size[a:b])
        if words:
            codes, w0 = word_codes(text)
            codes += 1
            n = np.diff(np.concatenate(([0], np.searchsorted(w0, np.cumsum(size[a:b])))))
        else:
            codes, n = np.unique(text, return_inverse=True)[1] + 1, size[a:b]
        ends = np.cumsum(n + 1) - 1
        symbols = np.zeros(int(ends[-1]) + 1, np.int64)
        spot = np.ones(len(symbols), bool)
        spot[ends] = False
        symbols[spot] = codes
        found = index(symbols, ends, owners[a:b], length).matching()
        begins = np.concatenate(([0], ends[:-1] + 1))
        turn = np.concatenate(([True], found[1:] != found[:-1]))
        turn[begins] = True
        cut = np.flatnonzero(turn & (found >= 0))
        until = np.minimum(np.append(cut[1:], len(found)), ends[np.searchsorted(ends, cut)] - length + 1)
        which = np.searchsorted(ends, cut)
        seg.append(which + a)
        start.append(cut - begins[which])
        stop.append(until - begins[which])
        owner.append(ids[found[cut]])
    seg, start, stop, owner = map(np.concatenate, (seg, start, stop, owner))
    per = np.searchsorted(seg, np.arange(len(first) + 1))
    rows, done = [], 0
    for b, top in zip(table.column("bucket").to_pylist(), high):
        h = every[done : done + len(top)]
        k = back[done : done + len(h)]
        done += len(h)
        n = per[k + 1] - per[k]
        runs = gather(np.arange(len(seg)), per[k], n)
        keep = owner[runs] < np.repeat(top, n)
        runs = runs[keep]
        if len(runs):
            rows.append((b, np.repeat(h, n, axis=0)[keep].tobytes(), start[runs].astype(np.int32).tobytes(), stop[runs].astype(np.int32).tobytes(), owner[runs].tobytes()))
    return _table(rows, names, kinds)


def _portions(sizes: np.ndarray, prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of about ``most`` bytes that keep equal fingerprints together, each indexed for itself."""
    edges = np.append(np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1]))), len(sizes))
    done, out, a = np.concatenate(([0], np.cumsum(sizes + 1))), [], 0
    while a < len(sizes):
        fits = edges[np.searchsorted(done[edges], done[a] + most, "right") - 1]
        b = int(fits if fits > a else edges[np.searchsorted(edges, a, "right")])
        out.append((a, b))
        a = b
    return out


def mark(docs: pa.Table, answers: pa.Table, words: bool, length: int, gram: int, null_last: bool = True) -> pa.Table:
    """Step 5: (doc_id, n_units, spans, kept) of a bucket's documents."""
    names = ["doc_id", "n_units", "spans", "kept"]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = [pa.int64(), pa.int64(), pa.list_(span), pa.binary()]
    if not len(docs):
        return _table([], names, kinds)
    bucket = load(docs, words, length, gram, windows=len(answers) > 0)
    gone = np.zeros((int(bucket.ends[-1]) if len(bucket.ends) else 0) + 1, np.int32)
    if len(answers):
        read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in answers.column(c).to_pylist()])
        known, start, stop, owner = read("hashes", np.uint64).reshape(-1, 2), read("from", np.int32), read("to", np.int32), read("owner", np.int64)
        order = np.argsort(known[:, 0], kind="stable")
        known, start, stop, owner = known[order], start[order], stop[order], owner[order]
        hashes = bucket.hashes(bucket.segments, length)
        a, b = np.searchsorted(known[:, 0], hashes[:, 0], "left"), np.searchsorted(known[:, 0], hashes[:, 0], "right")
        hit = np.flatnonzero(b > a)
        n = b[hit] - a[hit]
        runs, which = gather(np.arange(len(known)), a[hit], n), np.repeat(hit, n)
        s = bucket.segments.pick(which)
        limit = bucket.ids if null_last else np.where(docs.column("doc_id").is_null().to_numpy(), FIRST_ID, bucket.ids)
        keep = (owner[runs] < limit[s.doc]) & (known[runs, 1] == hashes[which, 1])
        first, runs = s.start[keep], runs[keep]
        np.add.at(gone, first + start[runs], 1)
        np.add.at(gone, first + stop[runs] + length - 1, -1)
    gone = np.cumsum(gone[:-1]) > 0
    rows, at = [], 0
    ids = docs.column("doc_id").to_pylist()
    raw = bucket.data
    for k, end in enumerate(bucket.ends.tolist()):
        out = gone[at:end]
        if words:
            part = [raw[a:b].tobytes() for a, b in zip(bucket.begin[at:end][~out], bucket.stop[at:end][~out])] if out.any() else None
            kept = b" ".join(part) if part is not None else b" ".join((docs.column("text")[k].as_py() or "").encode().split())
        else:
            kept = raw[at:end][~out].tobytes() if out.any() else raw[at:end].tobytes()
        edge = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0])))) if out.any() else ()
        rows.append((ids[k], end - at, [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])], kept))
        at = end
    return _table(rows, names, kinds)


def remove_repeats(
    docs: DataFrame, index, words: bool, length: int, gram: int, id_col: str = "doc_id", text: str = "text", null_last: bool = True
) -> DataFrame:
    """doc_id, n_units, spans (removed, in symbols of the document) and kept (bytes) per document.

    ``index``: class with (symbols, ends, owners from 0, length) and ``matching()``. ``null_last``: a null id
    ranks after all others; else no id is smaller than it, and its document stays whole.
    """
    parts = shuffle_parts(docs.sparkSession)
    n = SHARDS_PER_PARTITION * parts
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.pmod(F.xxhash64(id_col, text), F.lit(BUCKETS_PER_PARTITION * parts)).cast("int").alias("bucket")
    )
    prints = base.groupBy("bucket").applyInArrow(
        lambda t: send_fingerprints(t, n, words, length, gram), "shard int, bucket int, once binary, many binary"
    )
    repeated = prints.groupBy("shard").applyInArrow(answer_fingerprints, "bucket int, shard int, prints binary")
    segments = base.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(
        lambda d, a: send_segments(d, a, n, words, length, gram),
        "shard int, bucket int, prints binary, low binary, high binary, sizes binary, content binary",
    )
    answers = segments.groupBy("shard").applyInArrow(
        lambda t: answer_segments(t, index, words, length), "bucket int, hashes binary, `from` binary, `to` binary, owner binary"
    )
    span = "array<struct<start: long, end: long>>"
    return base.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
        lambda d, a: mark(d, a, words, length, gram, null_last), f"doc_id long, n_units long, spans {span}, kept binary"
    )
