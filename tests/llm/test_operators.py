"""The ten training-data operators against brute force on small, awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from threadspark.llm import decontam, fmindex, license, packing, pii, quality, repeats, runlength, simhash, tokencodes, urltree
from threadspark.llm.common import ship_code
from threadspark.llm.encoder import vocabulary_path

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, WORD = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")


def build(spark, rows, extra=True):
    """(doc_id, text) rows with columns whose names operators use inside."""
    ship_code(spark)
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(*r, "x", 7, b"k", 1) for r in rows], "doc_id long, text string, `row` string, n long, key binary, bucket int")


def corpus():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    shared = [say(40) for _ in range(4)]
    texts = [say(rnd.randint(0, 60)) for _ in range(30)]
    texts += [f"{say(5)}\n{rnd.choice(shared)} {say(6)}" for _ in range(25)]
    texts += [shared[0]] * 8 + ["", None, "a", "a" * 3000, "ab " * 900, "a" * 2000 + "b" * 60, " \t\n ", say(6000)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    return [*rows, (None, shared[1]), (None, None), (rows[0][0], shared[2]), (rows[0][0], shared[2])]


def windows(units, n):
    return [tuple(units[i : i + n]) for i in range(len(units) - n + 1)]


def brute_repeats(rows, split, n):
    top = float("inf")
    first: dict = {}
    for d, t in rows:
        for w in windows(split(t), n):
            first[w] = min(first.get(w, top), top if d is None else d)
    out = []
    for d, t in rows:
        units = split(t)
        gone = set()
        for i, w in enumerate(windows(units, n)):
            if first[w] < (top if d is None else d):
                gone.update(range(i, i + n))
        runs = sum(1 for i in gone if i - 1 not in gone)
        out.append((d, len(units), len(gone), runs, [u for i, u in enumerate(units) if i not in gone]))
    return out


@pytest.mark.parametrize("words", [False, True])
def test_repeats_match_brute_force(spark, words):
    rows = corpus()
    split = (lambda t: SPACES.findall(t or "")) if words else (lambda t: list((t or "").encode()))
    index, n, gram = (fmindex.FMIndex, 13, 4) if words else (runlength.RunLengthIndex, 50, 24)
    got = repeats.remove_repeats(build(spark, rows), index, words, n, gram).collect()
    got = Counter((r["doc_id"], r["n_units"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in got)
    glue = (lambda u: " ".join(u).encode()) if words else bytes
    assert got == Counter((d, a, b, c, glue(k)) for d, a, b, c, k in brute_repeats(rows, split, n))


def test_repeats_of_empty_table(spark):
    assert repeats.remove_repeats(build(spark, []), fmindex.FMIndex, True, 13, 4).collect() == []


@pytest.mark.parametrize("index", [fmindex.FMIndex, runlength.RunLengthIndex])
def test_index_against_scan(index):
    rnd = np.random.default_rng(3)
    strings = [rnd.integers(1, 4, rnd.integers(1, 40)) for _ in range(80)] + [np.ones(50, int)] * 2
    symbols = np.concatenate([np.append(s, 0) for s in strings])
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    owners = rnd.integers(0, 50, len(strings))
    low: dict = {}
    for s, o in zip(strings, owners):
        for w in windows(s.tolist(), 6):
            low[w] = min(low.get(w, 99), o)
    found = index(symbols, ends, owners, 6).matching()
    at = 0
    for s in strings:
        want = [low[w] for w in windows(s.tolist(), 6)]
        assert found[at : at + len(want)].tolist() == want
        assert (found[at + len(want) : at + len(s) + 1] == -1).all()
        at += len(s) + 1


def test_fm_count():
    text = np.array([1, 2, 1, 2, 1, 0, 2, 1, 0])
    fm = fmindex.FMIndex(text, np.array([5, 8]), np.array([0, 1]), 3)
    assert fm.count(np.array([2, 1])) == 3 and fm.count(np.array([1, 2, 1])) == 2 and fm.count(np.array([2, 2])) == 0 and fm.count(np.array([9])) == 0


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = [x.encode() for x in SPACES.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [2, 4096])
def test_simhash_components(spark, hot):
    rows = corpus() + [(1000 + k, f"Ab cd ef gh {k % 3}") for k in range(9)]
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    nodes = sorted({f for _, f in fps})
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low: dict = {}
    for d, f in fps:
        if d is not None:
            low[find(f)] = min(low.get(find(f), d), d)
    got = simhash.near_duplicates(build(spark, rows), hot=hot).collect()
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == Counter((d, f, low.get(find(f))) for d, f in fps)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
@pytest.mark.parametrize("hot", [1, 4096])
def test_links_are_complete(spark, bits, hot):
    rnd = random.Random(bits)
    base = [rnd.getrandbits(64) for _ in range(5)]
    fps = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 4))) for b in base for _ in range(12)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits, hot).collect()
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % 2**64).bit_count() <= bits}
    assert {(r["u"], r["v"]) for r in got} == want and len(got) == len(want)


def test_simhash_keeps_one_of_each(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "other words stand here"), (None, "a b c d"), (None, "quite new text of rows"), (None, "quite new text of rows")]
    got = simhash.keep_one(build(spark, rows))
    assert got.columns == build(spark, rows).columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, "a b c d"), (2, "other words stand here"), (None, "quite new text of rows")])


def test_repeated_ids_follow_their_own_text(spark):
    a, b = "a b c d e f g", "quite other words stand in this one"
    rows = [(3, a), (7, a), (7, b), (7, b), (8, "nothing like the others at all")]
    assert Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(build(spark, rows)).collect()) == Counter([(3, a), (7, b), rows[4]])
    clean = decontam.clean_documents(build(spark, rows), spark.createDataFrame([(1, a)], "item_id long, text string"))
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter([(7, b), (7, b), rows[4]])


def test_license_scan(spark):
    rows = [
        (1, "Some text\nReleased under the MIT License.\nall rights RESERVED"), (2, None), (3, ""), (4, "cc\nby cc-by general public license"),
        (5, "released license mit under the"), (6, "released under the license"), (7, "Licensed  under CC BY-NC 4.0."), (None, "éc by cc by"), (8, "x " * 20000 + "all rights reserved"), (8, "mit"),
    ]
    got = {(r["doc_id"], r["n_words"]): r for r in license.scan_licenses(build(spark, rows)).collect()}
    view = lambda k: (got[k]["n_base"], got[k]["first_word"], got[k]["last_word"], got[k]["base_labels"], got[k]["labels"], round(got[k]["score"], 3))
    assert view((1, 10)) == (1, 7, 7, ["reserved"], ["mit", "reserved"], 1.0)
    assert view((2, 0)) == view((3, 0)) == (0, None, None, [], [], 0.0)
    assert view((4, 7)) == (3, 0, 4, ["cc-by", "gpl"], ["cc-by", "gpl"], 1.0)
    assert view((5, 5)) == (0, None, None, [], ["mit"], 1.0)
    assert view((6, 4)) == (0, None, None, [], ["mit"], 0.8)
    assert view((7, 7))[4][0] == "cc-by" and "cc-by-nc" in view((7, 7))[4]
    assert view((None, 4)) == (1, 2, 2, ["cc-by"], ["cc-by"], 1.0)
    assert view((8, 20003))[:3] == (1, 20000, 20000)
    assert license.scan_licenses(build(spark, [])).collect() == []


def test_license_join_is_lossless(spark):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    templates = [(f"t{k}", " ".join(rnd.sample(words, rnd.randint(1, 8)))) for k in range(12)]
    texts = ["\n".join(" ".join(rnd.choices(words + ["zz"], k=rnd.randint(0, 10))) for _ in range(4)) for _ in range(60)]
    for percent in (50, 80, 100):
        got = license.scan_licenses(build(spark, list(enumerate(texts))), templates=templates, percent=percent).collect()
        for r in got:
            want = {(n, label) for n, line in enumerate(texts[r["doc_id"]].split("\n")) for label, t in templates
                    if 100 * len(set(t.split()) & set(line.split())) >= percent * len(set(t.split()))}
            assert {(b["line"], b["label"]) for b in r["blocks"]} == want


def test_license_scan_of_wrapped_notices(spark):
    mpl = " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed"
    bsd = "x = 1\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that"
    rows = [(1, mpl), (2, bsd), (3, mpl.replace("Public\n", "Public\n *\n")), (4, "released under\nplenty of other words\nthe mit license"), (5, f"a\n{mpl}\n{bsd}")]
    got = {r["doc_id"]: r for r in license.scan_licenses(build(spark, rows)).collect()}
    view = lambda k: [(b["line"], b["last"], b["label"], b["containment"]) for b in got[k]["wrapped"]]
    assert view(1) == [(0, 1, "mpl", 1.0)] and view(2) == [(1, 2, "bsd", 1.0)] and view(3) == view(4) == []
    assert [got[k]["labels"] for k in range(1, 6)] == [["mpl"], ["bsd"], [], [], ["bsd", "mpl"]] and got[1]["score"] == 1.0 and not got[1]["blocks"]
    assert sorted(view(5), key=lambda x: x[0]) == [(1, 2, "mpl", 1.0), (4, 5, "bsd", 1.0)]


def test_wrapped_license_runs_are_lossless(spark):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    templates = [(f"t{k}", " ".join(rnd.choices(words, k=rnd.randint(1, 8)))) for k in range(12)]
    texts = ["\n".join(" ".join(rnd.choices(words + ["zz"], k=rnd.randint(0, 6))) for _ in range(8)) for _ in range(60)]
    for percent in (50, 80, 100):
        for r in license.scan_licenses(build(spark, list(enumerate(texts))), templates=templates, percent=percent).collect():
            want: dict = {}
            for part in re.split(r"(?:^|\n)(?=\n|$)", texts[r["doc_id"]]):
                of = [(n, w) for n, line in enumerate(part.split("\n")) for w in line.split()]
                for label, t in templates:
                    size = min(len(t.split()), len(of))
                    for run in windows(of, size) if of else []:
                        hit = len(set(t.split()) & {w for _, w in run}) / len(set(t.split()))
                        if 100 * hit >= percent - 1e-9 and run[0][0] != run[-1][0]:
                            want[label] = max(want.get(label, 0), hit)
            best: dict = {}
            for b in r["wrapped"]:
                best[b["label"]] = max(best.get(b["label"], 0), b["containment"])
            assert best == want


def test_urls(spark):
    urls = [
        ("http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"), ("ftp://x.net", "x.net", "", None, None), ("http://net/", "net", "/", "net/", "block"),
        ("https://example.com/de/x#y", "example.com", "/de/x", "example.com/de/", "block"), ("//a.org/fr/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
        ("x://b.org/fr/://c", "b.org", "/fr/://c", "org/fr/", "allow"), ("x://h?q/z", "h", "", None, None), ("http://myexample.com/de/", "myexample.com", "/de/", None, None),
    ]
    pages = spark.createDataFrame([(k, u[0], "s") for k, u in enumerate(urls)] + [(None, "http://q/", "s"), (0, urls[0][0], "s")], "page_id long, url string, shape string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urltree.judge_urls(pages, none).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r["page_id"] is not None:
            u = urls[r["page_id"]]
            assert (r["host"], r["path"], r["rule"]) == u[1:4] and (u[4] is None or r["verdict"] == u[4])
    assert urltree.judge_urls(pages.limit(0), none).collect() == []


def test_url_templates_reject_impure_branches(spark):
    rows = [(k, f"http://h/{'good' if k % 2 else 'bad'}/{k}") for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k % 2 == 1 or k % 20 == 0), 0) for k in range(400)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["path"].split("/")[1]: (r["verdict"], r["template"]) for r in urltree.judge_urls(pages, labels).collect()}
    assert got["good"][0] == "allow" and got["bad"][0] == "block" and got["good"][1] != got["bad"][1]
    same = spark.createDataFrame([(k, 1, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    assert {r["template"] for r in urltree.judge_urls(pages, same).collect()} == {"/*/<n>"}


@pytest.mark.parametrize("known", [600, 50])
def test_url_templates_keep_a_heavy_branch_apart(spark, known):
    rows = [(k, f"http://h/x/slug{chr(97 + k % 26)}{'abcdefghijklmnopqrstuvwxyz'[k // 26 % 26]}") for k in range(600)]
    rows += [(k, f"http://h/x/hot/{k}") for k in range(600, 1000)]
    labels = spark.createDataFrame([(k, int(k < 600), 0) for k in [*range(known), *range(600, 1000)]], "doc_id long, quality int, toxic int")
    got = urltree.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert {(r["page_id"] < 600, r["template"], r["verdict"]) for r in got} == {(True, "/x/*", "allow"), (False, "/x/hot/<n>", "block")}


@pytest.mark.parametrize("prefix", ["en/2024/05/12", "a/b/c/d/e/f/g/h/i"])
def test_url_templates_follow_deep_paths(spark, prefix):
    topic = lambda k: "casino" if k % 2 else "science"
    pages = spark.createDataFrame([(k, f"http://h/{prefix}/{topic(k)}/{k}") for k in range(400)] + [(400, "http://h"), (401, f"http://h/{prefix}")], "page_id long, url string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    got = urltree.judge_urls(pages, labels).collect()
    assert len(got) == 402
    assert {(topic(r["page_id"]), r["template"].split("/")[-2], r["verdict"]) for r in got if r["page_id"] < 400} == {("casino", "casino", "block"), ("science", "science", "allow")}


def test_containment(spark):
    rnd = random.Random(9)
    items = [(k, " ".join(f"i{rnd.randint(0, 400)}" for _ in range(rnd.randint(3, 40)))) for k in range(15)] + [(15, None), (16, ""), (None, "one two three four five six")]
    texts = []
    for k in range(60):
        own = [f"d{rnd.randint(0, 4000)}" for _ in range(rnd.randint(0, 300))]
        piece = (rnd.choice(items[:15])[1]).upper().split()
        for _ in range(rnd.randint(0, 2)):
            piece[rnd.randrange(len(piece))] = "zz"
        texts.append((k, ", ".join([*own[:50], *piece, *own[50:]])))
    texts += [(90, None), (91, ""), (None, items[3][1]), (0, items[4][1]), (0, items[4][1]), (92, "one two three four five six")]
    got = decontam.contained_items(build(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    want = set()
    for i, a in items:
        n = min(5, len(plain(a))) or 5
        s = set(windows(plain(a), n))
        for d, t in texts:
            hit = len(s & set(windows(plain(t), n)))
            if s and 100 * hit >= 80 * len(s):
                want.add((d, i, len(s), hit))
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_matched"]) for r in got} == want and len(want) > 10
    clean = decontam.clean_documents(build(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    bad = {d for d, *_ in want}
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d for d, _ in texts if d not in bad)


def brute_ids(path, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


ODD = ["a   b", "a \n b", "a\n\nb", "a  ", "", "  x", "it's <|endoftext|> ok", "x\x00y z", "é, à. don't. a.. b,.", "a\t  b", "ΣΑΣ. Σ, İ.", "a\x1cb \x1c c", None, " \n", "a\r\n b", "x'. y'' z'.'s", "Straße 12.5 !!", "ab " * 5000]


def test_token_files(spark, tmp_path):
    rows = [(k * 7 % 50, t) for k, t in enumerate(ODD)] + [(3, "b"), (3, "a"), (3, "a"), (None, "x")]
    path = str(tmp_path / "tokens")
    tokencodes.write_tokens(build(spark, rows), path, BYTE, parts=3)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at, want = 0, []
    for d, t in ordered:
        ids = brute_ids(BYTE, t)
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = tokencodes.read_tokens(spark, path).collect()
    assert sorted((r["start"], r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((s, d is not None, d or 0, n, c) for d, s, n, c in want)
    full = tokencodes.read_tokens(spark, path, digest=False).orderBy("start").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in full] == [brute_ids(BYTE, t) for _, t in ordered]


def test_codes_give_any_token():
    ids = np.random.default_rng(1).choice([0, 5, 255, 256, 70000, 2**24, 2**32 - 1, 300], 3000).astype(np.uint32)
    codes = tokencodes.Codes(tokencodes.build_levels(ids))
    for i in [0, 1, 511, 512, 513, 1024, 2999, *range(700, 760)]:
        assert codes.token(i) == ids[i]
    for a, b in [(0, 3000), (5, 5), (511, 513), (100, 2000), (2999, 3000)]:
        assert codes.run(a, b).tolist() == ids[a:b].tolist()


def naive_best_fit(lengths, capacity):
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    for seed in range(30):
        rnd = random.Random(seed)
        cap = rnd.choice([10, 37, 100])
        lengths = [rnd.randint(1, cap) if rnd.random() < 0.7 else rnd.randint(1, 5) for _ in range(rnd.randint(0, 300))]
        plan, made = packing.best_fit_plan(Counter(lengths), cap)
        assert made == naive_best_fit(lengths, cap)


def test_packing(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(k + 100, "word " * (k % 7 * 11 + 1)) for k in range(150)] + [(5, "again"), (5, "again"), (None, "none")]
    got = packing.pack_documents(build(spark, rows), WORD, capacity=64, with_ids=True).collect()
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for parts in bins.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 64
    want = Counter()
    for d, t in rows:
        ids = brute_ids(WORD, t)
        want.update((d, k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert len(bins) == naive_best_fit([r["length"] for r in got], 64)
    assert packing.pack_documents(build(spark, []), WORD).collect() == []


def test_personal_data(spark):
    text = "Write to jo.e+x@mail.example.com or +1 (212) 555-0187, ip 10.0.0.255 and 300.1.1.1; card 4111 1111 1111 1111 no 4111111111111112"
    rows = [(1, text), (2, None), (3, ""), (4, "clean 12 words"), (None, "a@b.c"), (5, "é é@x a@b-c.de"), (6, "1" * 5000), (1, text)]
    got = {(r["doc_id"], len(r["base"])): r for r in pii.personal_data(build(spark, rows)).collect()}
    kinds = [(pii.KINDS[s["kind"]], text[s["start"] : s["end"]]) for s in got[(1, 4)]["base"]]
    assert kinds == [("email", "jo.e+x@mail.example.com"), ("phone", "+1 (212) 555-0187"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111")]
    assert (2, 0) in got and (3, 0) in got and (4, 0) in got and (None, 1) in got
    assert [(s["start"], s["end"]) for s in got[(5, 1)]["base"]] == [(6, 14)] and (6, 0) in got
    assert pii.personal_data(build(spark, [])).collect() == []


def test_revealing_terms(spark):
    rows = [(k, f"the agent Zorbl77 quixo wrote from a@b{k}.com for the people\nand the rest of the day goes on here {k}") for k in range(6)]
    rows += [(100 + k, "the people and the rest of the day wrote from here for the people " * 3) for k in range(40)]
    got = {r["doc_id"]: r for r in pii.personal_data(build(spark, rows)).collect()}
    flagged = lambda d: {rows[d][1][s["start"] : s["end"]] for s in got[d]["spans"] if s["kind"] == 4}
    assert flagged(0) == {"agent", "Zorbl77", "quixo"}
    assert got[100]["spans"] == []
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(build(spark, rows)).collect()}
    assert "Zorbl##" in clean[0] and "quixo" not in clean[0] and "<EMAIL>" in clean[0] and clean[100] == rows[6][1]
    counts = {bytes(r["term"]): r["n"] for r in pii.term_counts(build(spark, rows), spark.createDataFrame([(b"quixo",), (b"people",)], "term binary")).collect()}
    assert counts[b"quixo"] == 6 and counts[b"people"] == 6 + 80 * 3 and counts[b""] == sum(len(re.findall(r"[0-9a-z]+", t.lower())) for _, t in rows)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_revealing_terms_everywhere(spark, monkeypatch, bound):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", bound)
    rows = [(k, f"met Quillon Zorbl\nat 4111 1111 1111 1111, +1 212 555 0187, a@b.com today {k}\nand then QUILLON went on") for k in range(4)]
    rows += [(10 + k, "one line with quillon and no entity " + "the people went on and then met today at the rest of it " * 3) for k in range(3)]
    rows += [(30 + k, "the people went on and then met today at the rest of it " * 3) for k in range(60)]
    got = {r["doc_id"]: r for r in pii.personal_data(build(spark, rows)).collect()}
    text = dict(rows)
    flagged = lambda d: [text[d][s["start"] : s["end"]] for s in got[d]["spans"] if s["kind"] == 4]
    assert flagged(0) == ["Quillon", "Zorbl", "QUILLON"] and flagged(10) == ["quillon"] and flagged(30) == []
    assert [pii.KINDS[s["kind"]] for s in got[0]["base"]] == ["card", "phone", "email"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(build(spark, rows)).collect()}
    assert not any("quillon" in t.lower() for t in clean.values()) and clean[30] == text[30]


def test_revealing_terms_of_whole_documents(spark):
    far = "the people went on and then met today at the rest of it " * 3
    rows = [(k, f"{far}Quillon {far}\n\n{far}met at zo@b.com") for k in range(4)]
    rows += [(10 + k, f"{far}{far}{far}") for k in range(60)]
    rows += [(80 + k, f"{far}plain {far}") for k in range(9)]
    found = pii.personal_data(build(spark, rows)).collect()
    flagged = {dict(rows)[r["doc_id"]][s["start"] : s["end"]] for r in found for s in r["spans"] if s["kind"] == 4}
    words = lambda t: set(re.findall("[a-z]+", re.sub(r"\S+@\S+", "", t.lower())))
    held = {w: [d for d, t in rows if w in words(t)] for w in set().union(*(words(t) for _, t in rows))}
    want = {w for w, ds in held.items() if (c := sum(d < 4 for d in ds)) >= 3 and 2 * c >= len(ds) and math.log2(c * len(rows) / (len(ds) * 4)) >= 3}
    assert {w.lower() for w in flagged} == want == {"quillon"}


def brute_metrics(t):
    t = t or ""
    w = SPACES.findall(t)
    lines = [x for x in t.split("\n") if SPACES.search(x)]
    seen = Counter(windows(w, 8))
    hit = {i + k for i, x in enumerate(windows(w, 8)) if seen[x] > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_quality(spark):
    rows = corpus() + [(500, "a b c d e f g h " * 40), (501, "x #|<> y\nx #|<> y\n \nz"), (502, "one two three four five six seven eight " * 2), (503, "w " * 50)]
    got = quality.judge(build(spark, rows))
    keep = got.collect()
    view = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in keep)
    assert view == Counter((d, *brute_metrics(t)) for d, t in rows)
    for r in keep:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = quality.keep_good(build(spark, rows))
    assert kept.columns == build(spark, rows).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in keep if r["kept"])
    assert quality.judge(build(spark, [])).collect() == []


def test_label_model_recovers_shares():
    rnd = random.Random(4)
    share = [((0.02, 0.3, 0.68), (0.5, 0.3, 0.2)), ((0.01, 0.99, 0.0), (0.4, 0.6, 0.0)), ((0.03, 0.97, 0.0), (0.6, 0.4, 0.0)), ((0.05, 0.15, 0.8), (0.55, 0.25, 0.2))]
    votes = Counter()
    for _ in range(20000):
        y = int(rnd.random() >= 0.75)
        votes[tuple(rnd.choices((-1, 0, 1), s[y])[0] for s in share)] += 1
    m = quality.fit_label_model(sorted(votes.items()), 4, 100)
    assert abs(m["prior"] - 0.75) < 0.05
    for s, g, b in zip(share, m["good"], m["bad"]):
        assert all(math.isclose(x, y, abs_tol=0.06) for x, y in zip((*s[0], *s[1]), (*g, *b)))


def test_sha_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
