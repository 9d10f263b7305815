"""Inputs that went wrong once: crafted hash collisions, overlapping spans, long runs, written end marks, short items."""

import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from threadspark.llm import decontam, fmindex, pii, repeats, runlength, urltree
from threadspark.llm.encoder import WordEncoder, vocabulary_path
from test_operators import brute_repeats, build

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
PAIR = ("aabfcabchbaaabaeaa", "ffaaagaaaahafacaca")


def thue_morse(bits):
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("pair", [PAIR, thue_morse(10)], ids=["lattice", "thue-morse"])
def test_colliding_strings_are_not_repeats(spark, pair):
    same = "one two three four five six seven eight nine ten eleven twelve"
    head = "bplg nplnlakoahffcibccaoaihidflj"
    words = [(k, f"{same} {w}") for k, w in enumerate(pair)] + [(7, f"{same}\n{pair[0]}")]
    data = [(k, head + w) for k, w in enumerate(pair)] + [(7, head + pair[1])]
    for rows, index, as_words, n, gram in ((words, fmindex.FMIndex, True, 13, 4), (data, runlength.RunLengthIndex, False, 50, 24)):
        split = (lambda t: SPACES.findall(t or "")) if as_words else (lambda t: list((t or "").encode()))
        got = {r["doc_id"]: sum(s["end"] - s["start"] for s in r["spans"]) for r in repeats.remove_repeats(build(spark, rows), index, as_words, n, gram).collect()}
        assert got == {d: gone for d, _, gone, _, _ in brute_repeats(rows, split, n)}
        assert got[1] == 0 or len(pair[0]) > 50


def test_overlapping_spans_leave_nothing(spark):
    samples = {"email": "4111@mail.example.com", "ip": "10.1.2.3", "card": "4111 1111 1111 1111", "phone": "+1 212 555 0187"}
    assert pii.replaced("x 4111 1111 1111 1111@mail.example.com y", pii._span_rows(pii.entities("x 4111 1111 1111 1111@mail.example.com y"))) == "x <CARD> y"
    for (a, x), (b, y) in itertools.product(samples.items(), repeat=2):
        for text in (f"q {x}{y} z", f"q {x} {y} z", f"q {x}-{y} z"):
            spans = pii.entities(text)
            covered = {i for s, e, _ in spans for i in range(s, e)}
            left = "".join(c for i, c in enumerate(text) if i not in covered)
            marks = re.sub("<[A-Z]+>", "", pii.replaced(text, pii._span_rows(spans)))
            assert marks == left, (a, b, text)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_linear_search_equals_the_plain_patterns():
    rnd = random.Random(11)
    for _ in range(20_000):
        t = "".join(rnd.choice("a1.@@-_ %é.1") for _ in range(rnd.randint(0, 24)))
        assert pii.emails(t) == [m.span() for m in EMAIL.finditer(t)], t
        assert [m.span() for m in pii.IP.finditer(t)] == [m.span() for m in IP.finditer(t)], t


@pytest.mark.parametrize("text", ["a" * 2_000_000 + " x@y.zz", "1" * 2_000_000 + " 10.0.0.1", "1." * 500_000, "@a" * 500_000, "a@b." * 300_000, "+1 (" + " " * 1_000_000, "a@" + "b" * 1_000_000])
def test_long_runs_take_linear_time(text):
    began = time.perf_counter()
    pii.entities(text)
    assert time.perf_counter() - began < 8


@pytest.mark.parametrize("portion", [1, 40, 2_000_000])
@pytest.mark.parametrize("name,mode", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_written_end_marks_encode_as_the_library_does(monkeypatch, name, mode, portion):
    import pyarrow as pa

    from threadspark.llm import encoder

    monkeypatch.setattr(encoder, "PORTION", portion)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path(name))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|> B", "<|endoftext", None, "plain text", "a <|endoftext|> b" * 50, " <|endoftext|>\n"]
    ids, ends = WordEncoder(vocabulary_path(name), mode).encode(pa.array(texts))
    at = 0
    for t, end in zip(texts, ends):
        assert ids[at:end].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t
        at = end
    assert ids[: ends[0]].tolist() == ([64, 220, 50256, 275] if mode == "byte" else [320, 49407, 321])


def _odd_texts(n):
    rnd = random.Random(5)
    signs = [*"abzAZ09 \n  .,'\"-_<|>\t\r\x0b\x00\x1c\x85\xa0é\u0338\u0301İς漢😀\u3000K=~^`", "'s", "'LL", " the", " Word,", "it's", "x'tis", "\n\n", " <|endoftext|>"]
    words = ["the", "don't", "e.g.", "a@b.com", "(x)", "_y_", "1,000.5", "naïve.", "漢字,", "q\u0301.", "'tis", "A=B", "a\u200b.", "İ."]
    mixed = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(n)]
    prose = [" ".join(rnd.choice(words) + rnd.choice(["", ",", "'s", ")'"]) for _ in range(rnd.randint(1, 12))) for _ in range(n)]
    return [*mixed, None, "", *prose]


@pytest.mark.parametrize("portion,most", [(2_000_000, 500_000), (3_000, 200)])
@pytest.mark.parametrize("name,mode", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_odd_texts_encode_as_the_library_does(monkeypatch, name, mode, portion, most):
    """Also when the table of pieces is dropped again and again."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from threadspark.llm import encoder

    monkeypatch.setattr(encoder, "PORTION", portion)
    texts = _odd_texts(3_000)
    plain = Tokenizer.from_file(vocabulary_path(name))
    coder = WordEncoder(vocabulary_path(name), mode, most)
    for some in (pa.array(texts), pa.array(texts).slice(1_000, 3_000), pa.array([], pa.string()), pa.array([None, ""])):
        ids, ends = coder.encode(some)
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in some.to_pylist()]
        assert ends.tolist() == list(itertools.accumulate(map(len, want)))
        assert ids.tolist() == [i for w in want for i in w]


def test_unknown_pieces_reach_the_tokenizer_joined_and_once():
    """One call's overhead per unknown piece was a third of the tokenizer's time."""
    import pyarrow as pa

    class Spy:
        def __init__(self, plain):
            self.plain, self.asked = plain, []

        def encode_batch_fast(self, texts, **more):
            self.asked += texts
            return self.plain.encode_batch_fast(texts, **more)

    coder = WordEncoder(vocabulary_path("byte_bpe_50k.json"), "byte")
    coder.plain = spy = Spy(coder.plain)
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + j)}" for k in range(676)) + "." for j in range(20)]
    want = [spy.plain.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        ids, ends = coder.encode(pa.array(texts))
        assert ids.tolist() == [i for w in want for i in w] and ends.tolist() == list(itertools.accumulate(map(len, want)))
        assert 0 < len(spy.asked) < 300  # 13,520 different words
    assert sum(map(len, spy.asked)) < 1.1 * sum(map(len, texts))


@pytest.mark.parametrize("bound", [500_000, 0])
def test_short_items_are_found(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", bound)
    items = [(1, "what?"), (2, "Two words"), (3, "one two three"), (4, "alpha beta gamma delta"), (5, "alpha beta gamma delta epsilon"), (6, "...")]
    docs = [(10, "so WHAT, then"), (11, "two\nwords"), (12, "two other words"), (13, "zero one two three four"), (14, "alpha beta gamma delta epsilon"), (15, "alpha beta gamma"), (16, "whatever"), (17, None)]
    got = decontam.contained_items(build(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["item_id"], r["n_shingles"], r["n_matched"]) for r in got) == Counter(
        [(10, 1, 1, 1), (11, 2, 1, 1), (13, 3, 1, 1), (14, 4, 1, 1), (14, 5, 1, 1)]
    )
    clean = decontam.clean_documents(build(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in clean.collect()) == [12, 15, 16, 17]


def test_word_codes_tell_words_apart():
    data, begin, stop = repeats.one_blank(np.frombuffer(f"{PAIR[0]}  {PAIR[1]}\n{PAIR[0]} x ".encode(), np.uint8))
    codes, at = repeats.word_codes(data)
    assert codes.tolist() == [0, 1, 0, 2] and at.tolist() == begin.tolist()
    assert [data[a:b].tobytes().decode() for a, b in zip(begin, stop)] == [PAIR[0], PAIR[1], PAIR[0], "x"]


def test_long_paths_take_a_round_per_branching(spark, monkeypatch):
    written = []
    monkeypatch.setattr(urltree, "materialize", lambda df: written.append(1) or df.checkpoint())
    long = "/".join(f"s{chr(97 + k % 26)}" for k in range(2_000))
    rows = [(1, f"http://h/{long}"), (2, f"http://h/{long}/end"), (3, f"http://h/{long}/other/x"), (4, f"http://g/{long}"), (5, "http://h/a//b/"), (6, "http://k/")]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(1, 7)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["template"] for r in urltree.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    top = "/*/*/*" + long[8:]  # the first two segments merge with those of the short path, the third with its end
    assert got == {1: top, 2: top + "/*", 3: top + "/*/*", 4: "/" + long, 5: "/*/*", 6: ""}
    assert len(written) <= 12  # two a round; 2,000 levels would take 2,000


@pytest.mark.parametrize("name", ["op2_run_length_dedup", "op4_fm_index_dedup"])
def test_negative_and_null_ids_in_repeats(spark, tmp_path, name):
    """-1 once stood for "no match"; a null id has no smaller one, so its document stays whole."""
    from threadspark.llm.queries import QUERIES

    text = " ".join(f"word{k}" for k in range(30))
    build(spark, [(-7, text), (-1, "own start " + text), (3, text), (None, text), (4, None)], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    n = 30 if name.startswith("op4") else len(text)
    got = {r["doc_id"]: r["n_removed"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {-7: 0, -1: n, 3: n, None: 0, 4: 0}
