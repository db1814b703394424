import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orelode.llm import tokenizer

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = tokenizer.encoder().ranks
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(reference, text):
    assert tokenizer.encoder().encode(text) == reference.encode_ordinary(text)


def test_odd_texts(reference):
    e = tokenizer.encoder()
    texts = ["", " ", "\n\n  x", "a" * 5000, "ab" * 3000 + "!", "<|endoftext|>", "don't I'll we've", "\x1c\x1d a", "tab\t\tx\x0b\x0cy", "  \r\n", "日本語のテキスト", "é́ é", "1234567 v1.2.3", "x   y", "﻿bom", "=" * 999]
    for t in texts:
        assert e.encode(t) == reference.encode_ordinary(t), t[:20]
        assert reference.decode(e.encode(t)) == t
    assert e.encode(None) == []


def test_both_merges():
    ranks, r = tokenizer.encoder().ranks, random.Random(1)
    for _ in range(300):
        w = bytes(r.choice(b"abcdetion ing\xc3\xa9\xff\x00") for _ in range(r.randint(1, 300)))
        a = tokenizer.merge_short(w, ranks)
        assert a == tokenizer.merge_long(w, ranks)
        back = {v: k for k, v in ranks.items()} if not hasattr(test_both_merges, "back") else test_both_merges.back
        test_both_merges.back = back
        assert b"".join(back[i] for i in a) == w


def test_memory_of_words_is_bounded(monkeypatch, reference):
    monkeypatch.setattr(tokenizer, "CACHED_WORDS", 3)
    e = tokenizer.Encoder(open(tokenizer.VOCABULARY, "rb").read())
    text = "one two three four five six seven"
    assert e.encode(text) == reference.encode_ordinary(text) and len(e) <= 4


def test_operator(spark, reference):
    rows = [(1, "some text", "x"), (2, "", "x"), (3, None, "x"), (None, "y", "x"), (1, "some text", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")  # a clashing name
    got = sorted(((r.doc_id, r.ids) for r in tokenizer.token_ids(df).collect()), key=str)
    assert got == sorted(((d, reference.encode_ordinary(t or "")) for d, t, _ in rows), key=str)
    assert tokenizer.token_ids(df.limit(0)).count() == 0


def test_round_trip_of_texts(spark):
    rows = [(1, "é 日本\u200b\r\n\t x"), (1, "é 日本\u200b\r\n\t x"), (2, None), (3, ""), (4, "a" * 5_000), (None, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS ids")
    got = sorted((tuple(r) for r in tokenizer.texts_of(tokenizer.token_ids(docs)).collect()), key=str)
    assert got == sorted(((d, t or "") for d, t in rows), key=str)
