import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heddle.llm import bytebpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bytebpe.Replay(PATH).ranks
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    None, "", " ", "  \n\n  x", "Hello, World's it'll 1234 don'T we've I'd", "a" * 700 + "b" * 300, "ab" * 5000, "É İstanbul ΣΑΣ ſ ǅ", "é x́y ́",
    "<|startoftext|>a<|endoftext|><|endoftext|", "a\x1cb \x1d\x85c d e　f  ", "日本語 한국어 😀👍🏽", "՘₏\U00011de0\U00011de0 1²½Ⅷ", "x\x00y﻿", "\t\t\ttabs \r\n", " ' 's'S 'll'LL",
]


def want(t):
    return LIB.encode_ordinary(t or "")


def ids(t, memory=None):
    return np.frombuffer((memory or bytebpe.memory(PATH, P.PATTERN)).ids([t])[0], "<u4").tolist()


def test_matches_library(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit(7)).withColumn("decoded", F.lit("x"))
    rows = bytebpe.decode(bytebpe.encode(df, PATH, P.PATTERN), PATH).orderBy("doc_id").collect()
    for r, t in zip(rows, ODD, strict=True):
        assert list(r.ids) == want(t), t
        assert bytes(r.decoded) == (t or "").encode()


def test_empty_table_and_foreign_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bytebpe.decode(bytebpe.encode(df, PATH, P.PATTERN), PATH).count() == 0
    r = bytebpe.decode(spark.createDataFrame([([320, -1, 10**6, None],), (None,), ([],)], "ids array<int>"), PATH).collect()
    assert [bytes(x.decoded) for x in r] == [LIB.decode_bytes([320]), b"", b""]


def test_every_class_is_the_librarys():
    """Single characters of every block, each beside a letter, a number and a blank."""
    some = [chr(c) for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    memory = bytebpe.memory(PATH, P.PATTERN)
    for c in some:
        t = f"a{c}a 1{c}1 {c}  {c}'s"
        assert ids(t, memory) == want(t), hex(ord(c))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    assert ids(t) == want(t)


def test_slices_and_small_memory(monkeypatch):
    monkeypatch.setattr(bytebpe, "SLICE", 64)
    memory = bytebpe.Words(PATH, P.PATTERN, held=5)
    texts = ["the quick brown fox " * 30, "jumps over 12345 lazy dogs' ‹tails›  " * 20, None, "x" * 1000]
    for t, got in zip(texts * 2, memory.ids(texts * 2), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want(t)


def test_ranks_that_go_back(tmp_path):
    """A vocabulary in which a merge brings up a lower rank than its own: such words are done by themselves."""
    import base64

    path = tmp_path / "odd.tiktoken"
    every = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"bcd", b"aa", b"aaaa", b"aab"]
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(every)) + b"\n")
    replay = bytebpe.Replay(str(path))
    lib = tiktoken.Encoding("odd", pat_str=r"[^x]+", mergeable_ranks=replay.ranks, special_tokens={})
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcd"), size=rng.integers(1, 12))).encode() for _ in range(500)]
    for w, got in zip(words, replay.words(words), strict=True):
        if w not in replay.ranks:
            assert np.frombuffer(got, "<u4").tolist() == lib.encode_ordinary(w.decode()), w


def test_patterns_and_files_that_cannot_be(tmp_path):
    with pytest.raises(ValueError, match="letters"):
        bytebpe.Classes().named(r"\w+")
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="no token"):
        bytebpe.Replay(str(tmp_path / "few"))


def test_query(spark):
    from heddle.llm import queries

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_bytebpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == df.count()
    for doc_id, text in df.select("doc_id", "text").collect():
        own = want(text)
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
