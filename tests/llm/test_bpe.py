import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heddle.llm import bpe

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
ODD = [
    None, "", " ", "Hello, World's it'll 1234 don'T", "a" * 700 + "b" * 300, "ab" * 500, "É İstanbul ΣΑΣ ſ ǅ", "é x́y ́",
    "<|startoftext|>a<|endoftext|><|endoftext|", "a\x1cb \x1d\x85c d e　f", "日本語 한국어 😀👍🏽", "՘₏\U00011de0\U00011de0 1²½", "x\x00y﻿",
]


def want(t):
    return LIB.encode(t or "", add_special_tokens=False).ids


def test_matches_library(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit(7))
    rows = bpe.decode(bpe.encode(df, PATH), PATH).orderBy("doc_id").collect()
    for r, t in zip(rows, ODD, strict=True):
        assert list(r.ids) == want(t), t
        assert r.decoded == LIB.decode(want(t), skip_special_tokens=False)


def test_empty_table_and_foreign_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH), PATH).count() == 0
    r = bpe.decode(spark.createDataFrame([([320, -1, 10**6],), (None,)], "ids array<int>"), PATH).collect()
    assert r[0].decoded == LIB.decode([320], skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    import numpy as np

    assert np.frombuffer(bpe.encoder(PATH).ids(t), "<i4").tolist() == want(t)


def test_new_words_are_merged_together(monkeypatch):
    """Ten times the new words take no more calls, of the merge of one word or of the ranks looked up at once."""
    calls = []
    one, many = bpe.RankArray.encode, bpe.RankArray.places
    monkeypatch.setattr(bpe.RankArray, "encode", lambda *a: calls.append(1) or one(*a))
    monkeypatch.setattr(bpe.RankArray, "places", lambda *a: calls.append(1) or many(*a))
    encoder, pick = bpe.encoder.__wrapped__(PATH), random.Random(5)

    def taken(n):
        calls.clear()
        texts = [" ".join("".join(pick.choices("abcdefghijklmnoprstuéß", k=pick.choice((6, 7, 8)))) for _ in range(100)) for _ in range(n)]
        assert encoder.of_texts(pa.array(texts)).to_pylist() == [want(t) for t in texts]
        return len(calls)

    few, more = taken(10), taken(100)
    assert more <= 2 * few < 200


@pytest.mark.parametrize("size, few, side", [(1 << 22, 32, 1 << 17), (16, 1, 64), (300, 4, 1)])
def test_texts_together(monkeypatch, size, few, side):
    for name, value in (("SLICE", size), ("FEW", few), ("SIDE", side)):
        monkeypatch.setattr(bpe, name, value)
    short = ["don't 't's ''s a's!s we'LL'd 1's '", "they've'rest 'really 'vex l'l", *("a" * n + " B" * n + "xyz"[: n % 4] * n for n in (198, 199, 200, 201, 256))]
    texts = [*ODD, *short, "", *(f"A{chr(c)}b{chr(c)}'S" for c in range(0x260)), *ODD[::-1], " x", None]
    for some in (texts, [], [None], ["", " "], ["<|endoftext|>"]):
        for kind in (pa.string(), pa.large_string()):
            got = bpe.encoder(PATH).of_texts(pa.array(["before", *some], kind)[1:])
            assert got.type == pa.list_(pa.int32()) and got.to_pylist() == [want(t) for t in some]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text("aAbEeéßst'lr1²!<|> \n\x1c", max_size=30), max_size=8))
def test_any_texts(texts):
    assert bpe.encoder(PATH).of_texts(pa.array(texts, pa.string())).to_pylist() == [want(t) for t in texts]


def test_query(spark):
    from heddle.llm import queries

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_bpe(spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in df.select("doc_id", "text").collect():
        ids = want(text)
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()
