import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heddle.llm import tokenfile
from heddle.llm.common import scratch

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=3000), st.integers(1, 40))
def test_round_trip(ids, more):
    a = np.array(ids * more, np.uint32)
    m = tokenfile.Model(*np.unique(np.append(a, 5), return_counts=True))
    words, rows, starts, states = m.encode(a)
    if len(a):
        assert (m.decode(len(a), words, rows, starts, states) == a).all()


def test_checkpoints_and_damage():
    a = np.random.default_rng(1).geometric(0.01, 500_000).astype(np.uint32)
    m = tokenfile.Model(*np.unique(a, return_counts=True))
    words, rows, starts, states = m.encode(a)
    assert len(rows) == 4 and len(words) < 1.1 * len(a)
    parts = [m.decode(len(a), words, rows, starts, states, i, i + 1) for i in range(len(rows))]
    assert (np.concatenate(parts) == a).all()
    with pytest.raises(ValueError):
        m.decode(len(a), words[:-4] + b"\0\0\0\0", rows, starts, states)


def test_files(spark):
    texts = [None, "", "a b", "a b", "x" * 3000, "Zürich 12", "<|endoftext|> y"]
    df = spark.createDataFrame([*((10 - i, t) for i, t in enumerate(texts)), (None, "n"), (10, "tie"), (10, "tie")], "doc_id long, text string")
    path = scratch(spark)
    tokenfile.write(df.withColumn("start", F.lit("x")), path, PATH, 2, shards=3)
    got = tokenfile.read(spark, path).collect()
    want = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    got.sort(key=lambda r: r.start)
    at = 0
    for g, w in zip(got, want, strict=True):
        ids = [*LIB.encode(w.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, list(g.ids)) == (w.doc_id, at, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty_table(spark):
    path = scratch(spark)
    tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH, 2)
    assert tokenfile.read(spark, path).count() == 0


def test_query(spark):
    from heddle.llm import queries

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(queries.op2_tokenfile(spark, d).collect(), key=lambda r: r.doc_id)
    at = 0
    for g, w in zip(got, docs, strict=True):
        ids = [*LIB.encode(w.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (w.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_checksums_are_joined():
    r = random.Random(1)
    for _ in range(50):
        parts = [r.randbytes(r.choice([0, 1, 4, 1000])) for _ in range(r.randint(0, 5))]
        assert tokenfile.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_large_blocks_are_read_in_pieces(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(["the", "of", "word", "résumé", "x9"], k=r.choice([3, 50, 4000])))) for i in range(40)]
    rows.append((7, " ".join(r.choices(["long", "text", "of", "a", "document"], k=1_400_000))))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit(1), "block": F.lit(2)})
    path = f"file://{tmp_path}/t"
    tokenfile.write(df, path, PATH, end_id=2, shards=2)
    sizes = [x.n for x in spark.read.parquet(f"{path}/blocks").selectExpr("size(check_rows) AS n").collect()]
    assert max(sizes) > tokenfile.PIECE
    got = tokenfile.read(spark, path).collect()
    want = sorted((d, [*LIB.encode(t, add_special_tokens=False).ids, 2]) for d, t in rows)
    assert sorted((x.doc_id, x.ids) for x in got) == want
    assert all(x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) and x.n_tokens == len(x.ids) for x in got)
    last = max(got, key=lambda x: x.start)
    assert last.start + last.n_tokens == sum(len(i) for _, i in want)


def test_words_are_looked_up_together(monkeypatch):
    """Plain words take no step of the memory each; the library gets each new pre-token once, for all slices of texts."""
    import pyarrow as pa

    from heddle.llm import bpe, tokens, words

    monkeypatch.setattr(bpe, "SLICE", 2000)
    single = []
    one = words.WordMemory.__missing__
    monkeypatch.setattr(words.WordMemory, "__missing__", lambda m, w: single.append(w) or one(m, w))
    pick = random.Random(3)
    texts = [" ".join("".join(pick.choices("abcdéß'9.", k=4)) for _ in range(100)) for _ in range(50)]
    tokens.memory.cache_clear()
    memory, given = tokens.memory(PATH), []
    inner = memory.encode
    monkeypatch.setattr(memory, "encode", lambda w: given.append(w) or inner(w))
    odd = [None, "", "日本 <|endoftext|>a", "x\x1cy", "٣ ſ"]
    for kind in ("<u2", "<u4"):
        got = tokenfile.ended(pa.array(["before", *texts, *odd])[1:], PATH, 2, kind)
        assert [np.frombuffer(x, kind).tolist() for x in got.to_pylist()] == [[*LIB.encode(t or "", add_special_tokens=False).ids, 2] for t in [*texts, *odd]]
    assert len(given) == len(set(given)) and not set(single) & set(" ".join(texts).split())
    assert tokenfile.ended(pa.array([], pa.string()), PATH, 2, "<u2").to_pylist() == []
