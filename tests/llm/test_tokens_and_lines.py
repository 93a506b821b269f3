"""Problems 6, 7 and 8."""

import re
import unicodedata

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trendloom.llm import boilerplate, boilerplate_queries, bpe, lookalike
from tests.compare import same

WORDS = st.text(alphabet="abcé đ0 \n\t'’漢😀́<|>", max_size=60)


@pytest.fixture(scope="module")
def oracle():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_corpus_is_that_of_the_public_encoder(spark, data, oracle):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(docs).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == (oracle.encode_ordinary(r["text"]) if r["text"] else [])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), WORDS), max_size=6))
def test_any_text(oracle, texts):
    flat, ends = bpe.encoder(bpe.VOCABULARY).encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [oracle.encode_ordinary(t) if t else [] for t in texts]


def test_hard_texts(spark, oracle):
    texts = [None, "", " ", "a" * 5000, "ab" * 3000, "<|endoftext|>", "xin chào​ " * 5000, "same", "same"]
    df = spark.createDataFrame([(n, t, "x", [1]) for n, t in enumerate(texts)], "doc_id long, text string, __text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df).collect()}
    assert [got[n] for n in range(len(texts))] == [oracle.encode_ordinary(t) if t else [] for t in texts]
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_vocabulary_of_many_words_is_emptied(oracle, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    e = bpe.BatchedBPE()
    for k in range(5):
        t = " ".join(f"w{k}x{j}" for j in range(20))
        assert e.encode([t])[0].tolist() == oracle.encode_ordinary(t)


@pytest.mark.parametrize(("a", "b"), [
    ("Nguyễn Huệ", unicodedata.normalize("NFD", "Nguyễn Huệ")), ("a b", "a b"), ("a b", "a b"), ("Topic", "Tорiс"), ("Tin", "Тіn"), ("ABC", "ＡＢＣ"), ("sốt", "s​ốt"),
    ("của", "củ­a"), ("office", "oﬃce"), ("a\nb", "a \r\nb"), ("về", "về"), ("đêm", "﻿đêm"),
])
def test_look_the_same(a, b):
    assert lookalike.skeleton(a) == lookalike.skeleton(b) and a != b


@pytest.mark.parametrize(("a", "b"), [("m²", "m2"), ("a", "á"), ("a", "A"), ("½", "1/2"), ("bao", "báo"), ("👨‍👩‍👧", "👨👩👧"), ("bình", "binh"), ("a…", "a")])
def test_look_different(a, b):
    assert lookalike.skeleton(a) != lookalike.skeleton(b)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aăâế ộé̛̂̉о​ \r\n\tＡｶﾞ각각👨‍👩️x…"), max_size=30))
def test_canonical_is_stable_and_composed(s):
    c = lookalike.canonical(s)
    assert lookalike.canonical(c) == c and unicodedata.is_normalized("NFC", c)
    plain = re.sub("[​‍]", "", unicodedata.normalize("NFC", s))
    if lookalike.skeleton(plain) != lookalike.skeleton(s):
        assert "‍" in s or "​" in s  # joiners inside emoji are kept


def test_pairs_are_those_of_brute_force(spark):
    texts = ["Tin nóng", "Tin nóng", "Тin nóng", "Tin nóng", "tin nóng", None, "", " ", " ", "Khác", "x" * 100_000, "x" * 100_000 + "​"]
    df = spark.createDataFrame([(n, t, "a" if n != 3 else "b", "look") for n, t in enumerate(texts)], "id long, text string, tbl string, spelling string")
    got = {tuple(r) for r in lookalike.lookalike_pairs(df, "id", "text", "tbl").collect()}
    want = {("a", i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and 3 not in (i, j) and a and b and a.strip() and a != b and lookalike.skeleton(a) == lookalike.skeleton(b)}
    assert got == want and len(want) == 4
    c = {r["id"]: (r["class_id"], r["spelling_id"]) for r in lookalike.lookalike_classes(df, "id", "text", "tbl").collect()}
    assert set(c) == {i for _, *ab in want for i in ab}
    assert {(i, j) for i in c for j in c if i < j and c[i][0] == c[j][0] and c[i][1] != c[j][1]} == {tuple(ab) for _, *ab in want}
    assert lookalike.lookalike_pairs(df.limit(0), "id", "text", "tbl").count() == 0
    n = {r["id"]: (r["normalised"], r["changed"]) for r in lookalike.normalise_texts(df, "id", "text").collect()}
    assert n[1] == ("Tin nóng", True) and n[0] == ("Tin nóng", False) and n[5] == (None, False) and n[2] == ("Tin nóng", True)


def test_lines(spark):
    many = [(n, "s", f"bài {'abcde'[n]}xyz\nXem tiếp, mã {n * 7}\n\n") for n in range(5)]
    more = [(10, "s", "XEM  TIẾP, MÃ 1.234\r\nkhác"), (11, "t", "Xem tiếp, mã 1"), (12, None, "Xem tiếp, mã 1"), (13, "s", None), (14, "s", ""), (15, "s", "z" * 200_000)]
    copies = [(20 + n, "s", "một bài đăng lại\nhai") for n in range(9)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in many + more + copies], "id long, source string, content string, line string, line_no int")
    got = {tuple(r) for r in boilerplate.find_repeated_lines(df).collect()}
    assert got == {(n, 2) for n in range(5)} | {(10, 1)}  # nine copies of one post are one post
    c = {r["id"]: (r["cleaned"], r["n_removed"]) for r in boilerplate.without_repeated_lines(df).collect()}
    assert c[0] == ("bài axyz\n\n", 1) and c[10] == ("khác", 1) and c[13] == (None, 0) and c[14] == ("", 0) and len(c) == df.count()
    assert boilerplate.find_repeated_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(boilerplate_queries.SQL))
def test_lines_same_as_sql(spark, data, duck, name):
    same(boilerplate_queries.QUERIES[name](spark, data).toPandas(), duck.execute(boilerplate_queries.SQL[name]).df())
