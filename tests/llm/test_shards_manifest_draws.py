"""Operators 11 to 13 against brute force on small, awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from threadspark.llm import importance, merkle, sharding
from threadspark.llm.common import numbered, running_total, ship_code

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot_ string, n long, bits string"


def build(spark, rows):
    ship_code(spark)
    return spark.createDataFrame([(*r, "x", 3, "y") for r in rows], DOCS)


def corpus():
    rnd = random.Random(8)
    langs = ["en"] * 6 + ["de", "fr", "zh", "", None]
    words = ["alpha", "Beta", "gamma,", "Déjà", "文字", "x1", "-", "É"]
    rows = []
    for k in range(700):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))
        rows.append((k * rnd.choice([1, 1, 1, 977]) - 40, text, rnd.choice(langs), rnd.choice(["a", None, "b"]), len(text)))
    rows += [(k, None, "de", None, None) for k in range(3)] + [(5000, "", "en", "a", 0), (5001, "w" * 5000 + " y", "en", "a", 2), (5002, "Long Words " * 3000, "fr", "a", 1)]
    rows += [rows[3]] * 9 + [(None, f"t{k % 4}", "en", "a", 1) for k in range(12)] + [(7, f"same id {k}", "en", "a", 1) for k in range(70)]
    rows += [(9_000_000_000_000_000_000, "far", "one", "s", 3), (-9_000_000_000_000_000_000, "far", "en", "s", 3)]
    rnd.shuffle(rows)
    return rows


# ---------------------------------------------------------------- 12


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row, text):
    d, _, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def tree(nodes):
    """All levels."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def proof(levels, slot):
    out = []
    for level in levels[:-1]:
        run = slot // 8 * 8
        out.append(("".join(level[run:slot]), "".join(level[slot + 1 : run + 8])))
        slot //= 8
    return out


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[g] = tree([leaf_of(r, r[1]) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = Counter()
    for k, g in enumerate(order):
        for slot, r in enumerate(groups[g]):
            path = proof(trees[g], slot) + proof(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = re.sub("[A-Z]", lambda m: m.group().lower(), r[1]) if hit and r[1] is not None else r[1]
            node = leaf_of(r, text)
            for before, after in path:
                node = sha(before + node + after)
            out[(r[0], leaf_of(r, r[1]), trees[g][-1][0], top[-1][0], sha("".join(b + a for b, a in path)), node, node == top[-1][0])] += 1
    return out


@pytest.mark.parametrize("rows", [corpus(), corpus()[:1], [(3, "A", None, None, 1), (1, "B", "x", "y", 2)]], ids=["all", "one", "two"])
def test_manifest_matches_brute_force(spark, rows):
    got = Counter(tuple(r) for r in merkle.verify(build(spark, rows)).collect())
    assert got == brute_manifest(rows)


def test_manifest_of_empty_table(spark):
    assert merkle.verify(build(spark, [])).collect() == []


def test_tall_tree(spark):
    """More than two rounds of three levels: 600 x 512 leaves of one group."""
    n = 520 * 512 + 3
    docs = spark.range(n).selectExpr("id AS doc_id", "'en' AS lang", "'t' AS text", "'s' AS source", "1L AS n_chars")
    m = merkle.manifest(docs, "doc_id", "lang", ["doc_id", "text"])
    want = tree([sha(f"{len(str(k))}:{k}1:t") for k in range(n)])
    got = m.where(F.col("id") % 50021 == 0).collect()
    assert len(got) == 6 and {r["subroot"] for r in got} == {want[-1][0]} == {r["root"] for r in got}
    for r in got:
        assert r["slot"] == r["id"] and [(s["before"], s["after"]) for s in r["path"]] == proof(want, r["id"])


# ---------------------------------------------------------------- helpers


def test_numbering_and_totals(spark):
    rnd = random.Random(3)
    values = [rnd.choice([None, 7, 7, 7, rnd.randint(-50, 50)]) for _ in range(400)]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v int, k long").repartition(5, "k")
    got = sorted((r["at"], r["v"]) for r in numbered(df, ["v"], "at", "k").collect())
    assert [a for a, _ in got] == list(range(400))
    assert [v for _, v in got] == sorted(values, key=lambda v: (v is not None, v or 0))
    sums = running_total(df.groupBy("v").agg(F.count("*").alias("n")), ["v"], "n", "upto").collect()
    key = lambda v: (v is not None, v or 0)
    assert all(r["upto"] == sum(key(x) < key(r["v"]) for x in values) for r in sums)


# ---------------------------------------------------------------- 11


def xx(*parts):
    h = 42
    for p in parts:
        if p is None:
            continue
        size = 4 if isinstance(p, np.int32) else 8
        h = xxh64_intdigest(int(p).to_bytes(size, "little", signed=True), h)
    return h


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def draw(total, good, draws, u):
    """Inversion from the mode outward, in plain floats."""
    rest = total - good
    low, high = max(0, draws - rest), min(draws, good)
    if low == high:
        return low
    mode = max(low, min(math.floor((float(draws) + 1) * (float(good) + 1) / (float(total) + 2)), high))
    ups, w = [], 1.0
    for x in range(mode, high):
        w *= (float(good - x) * float(draws - x)) / (float(x + 1) * float(rest - draws + x + 1))
        ups.append((x + 1, w))
    downs, w = [], 1.0
    for x in range(mode, low, -1):
        w *= (float(x) * float(rest - draws + x)) / (float(good - x + 1) * float(draws - x + 1))
        downs.append((x - 1, w))
    weights = [(mode, 1.0), *ups, *downs]
    target, total_w = u * math.fsum(w for _, w in weights), 0.0
    for x, w in weights:
        total_w += w
        if total_w > target:
            return x
    return weights[-1][0]


def brute_shards(ids, shards, seed):
    """The whole shuffle for distinct, non-null ids."""
    n = len(ids)
    levels = max(1, round(math.log(max(n, 2), 16) / 2))
    i32 = np.int32
    key = {i: signed(xx(i32(seed), i, -1)) for i in ids}
    block = lambda k, i: signed(xx(i32(k), key[i])) % 16**levels
    held = {}
    for i in ids:
        held.setdefault(block(1, i), []).append(i)
    left = {0: [n // shards + (j < n % shards) for j in range(shards)]}
    for level in range(1, levels + 1):
        shift, nxt = 4 * (levels - level), {}
        sums = Counter()
        for b, members in held.items():
            sums[b >> shift] += len(members)
        for child in sorted(sums):
            places, rows, out = left[child >> 4], sums[child], []
            total = sum(places)
            for j in range(shards):
                u = ((xx(i32(seed), (level << 40) + child, i32(j)) >> 11) + 0.5) / 2**53
                x = draw(total, places[j], rows, u)
                total, rows = total - places[j], rows - x
                out.append(x)
            left[child >> 4] = [a - b for a, b in zip(places, out)]
            nxt[child] = out
        left = nxt
    parts = {}
    for b, members in held.items():
        members.sort(key=lambda i: (signed(xx(i32(2), key[i])), i))
        at = 0
        for j, x in enumerate(left[b]):
            for i in members[at : at + x]:
                parts.setdefault(j, []).append(i)
            at += x
    out = {}
    for j, members in parts.items():
        members.sort(key=lambda i: (block(3, i), signed(xx(i32(4), key[i])), i))
        out.update({i: (j, k) for k, i in enumerate(members)})
    return out


@pytest.mark.parametrize("n,shards", [(1, 16), (5, 16), (90, 7), (1500, 16), (5000, 3)])
def test_shuffle_matches_brute_force(spark, n, shards):
    ids = random.Random(n).sample(range(-n, 9 * n), n)
    df = spark.createDataFrame([(i, "p") for i in ids], "doc_id long, payload string").repartition(3)
    got = {r["row"]["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffle_rows(df, "doc_id", shards).collect()}
    assert got == brute_shards(ids, shards, 42)


def test_shards_of_awkward_rows(spark):
    rows = corpus()
    got = sharding.shard_table(build(spark, rows)).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == j) == list(range(counts[j])) for j in range(16))
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) > 8  # one id's rows do not stay together
    assert sharding.shard_table(build(spark, [])).collect() == []
    clash = build(spark, rows).withColumnsRenamed({"slot_": "slot", "lang": "shard", "bits": "row", "source": "key"})
    again = sharding.shuffle_rows(clash, "doc_id", 4)
    assert again.select("row.*").columns == clash.columns and again.select("row.doc_id", "row.shard").exceptAll(clash.select("doc_id", "shard")).isEmpty()


def test_hypergeometric_law(spark):
    total, good, draws, n = 60, 22, 17, 20000
    u = ((F.col("id") + 0.5) / n).alias("u")
    lit = lambda v: F.lit(v).cast("long")
    got = Counter(r["x"] for r in spark.range(n).select(sharding.hypergeometric(lit(total), lit(good), lit(draws), u).alias("x")).collect())
    law = {x: math.comb(good, x) * math.comb(total - good, draws - x) / math.comb(total, draws) for x in range(draws + 1)}
    assert all(abs(got[x] - n * p) <= 2 for x, p in law.items())  # an even grid of u meets every probability to a grid step


def test_shuffle_is_uniform(spark):
    """Over many seeds every row meets every shard equally often, and neighbours are independent."""
    df = spark.range(64).withColumnRenamed("id", "doc_id")
    seen, together = np.zeros((64, 4)), 0
    for seed in range(40):
        shard = {r["row"]["doc_id"]: r["shard"] for r in sharding.shuffle_rows(df, "doc_id", 4, seed).collect()}
        for i, j in shard.items():
            seen[i, j] += 1
        together += sum(shard[i] == shard[i + 1] for i in range(63))
    assert (seen.sum(axis=1) == 40).all() and (seen.sum(axis=0) == 640).all()
    assert ((seen - 10) ** 2 / 10).sum() < 64 * 3 * 1.5
    assert abs(together / (40 * 63) - 15 / 63) < 0.04


def test_written_shards(spark, tmp_path):
    rows = corpus()
    sharding.write_shards(build(spark, rows), f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r["row"]["doc_id"], r["row"]["text"]) for r in back.collect()) == Counter((d, t) for d, t, *_ in rows)
    assert set(back.columns) == {"row", "shard", "slot"} and back.select("row.*").columns == build(spark, rows).columns


# ---------------------------------------------------------------- 13

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    w = PLAIN.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_draw(docs, target, buckets=10000, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, runs(text)[1]))
    for text in target:
        t.update(map(bucket, runs(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for d, text in docs:
        w, f = runs(text)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append((d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((o for o in out if o[1] >= 20), key=lambda o: (-o[4], o[0] is not None, o[0] or 0))
    ranks = Counter((o, k + 1) for k, o in enumerate(able[: percent * len(able) // 100]))
    return Counter(out), ranks


def test_draw_matches_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    docs = [(d, t) for d, t, *_ in corpus()]
    target = [" ".join(rnd.choice(["alpha", "gamma", "文字", "new"]) for _ in range(30)) for _ in range(20)] + [None, ""]
    want, ranks = brute_draw(docs, target)
    got = importance.resample(build(spark, corpus()), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    key = lambda r: (r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"])
    assert Counter(map(key, got)) == want
    assert Counter((key(r), r["rank"]) for r in got if r["rank"] is not None) == ranks and ranks


def test_draw_from_empty_tables(spark):
    one = build(spark, [(1, "Some words " * 12, "en", None, 1)])
    none = spark.createDataFrame([], "text string")
    assert importance.resample(build(spark, []), none).collect() == []
    r = importance.resample(one, none, percent=100).collect()[0]
    assert (r["n_features"], r["rank"]) == (69, 1)
    assert importance.drawn_documents(one, none, percent=100).columns == one.columns


@pytest.mark.parametrize("size", [1, 7, 60, 4_000_000])
def test_portions_share_words(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(importance, "PORTION", size)
    texts = ["", None, "One two", "a", "x " * 50 + "Q" * 90 + " end", "ääö é, ü\n" * 9, "tail of words here", " ", "9" * 2000 + " a b"]
    got = [Counter() for _ in texts]
    n = [0] * len(texts)
    for first, words, carried in importance.portions(pa.array(texts)):
        for text, crc in words.features(carried):
            for k, c in zip(text.tolist(), crc.tolist()):
                got[first + k][c] += 1
        for k in words.text[carried:].tolist():
            n[first + k] += 1
    assert n == [len(runs(t)[0]) for t in texts]
    assert got == [Counter(zlib.crc32(f.encode()) for f in runs(t)[1]) for t in texts]


def test_crc_matrix():
    rnd = np.random.default_rng(1)
    data = rnd.integers(0, 256, 5000).astype(np.uint8)
    start = rnd.integers(0, 3000, 300)
    size = rnd.integers(0, 1500, 300)
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, size)]
    assert importance.slice_crcs(data, start, size).tolist() == want
