import hashlib
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as C
from heddle.llm import mixing, quality
from heddle.llm.simhash import fingerprint
from tests.llm.test_mixing import brute as mix_brute
from tests.llm.test_quality import brute_stats, brute_verdicts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = " \t\n\x0b\x0c\r"


def corpus(n=260, seed=11):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(500)]
    line = lambda k: " ".join(r.choices(vocab, k=k))
    shared = [line(8) for _ in range(3)]
    rows = []
    for i in range(n):
        lines = [line(r.randint(6, 20)) for _ in range(r.randint(6, 25))]
        if i % 5 == 0:
            lines.insert(1, r.choice(shared))
        if i % 9 == 0:
            lines = [" ".join(w + "###" for w in x.split()) for x in lines]
        if i % 7 == 3 and i > 60:
            lines = rows[i - 60][1].split("\n")
            lines[-1] += " more"
        rows.append((i, "\n".join(lines), r.choice(["en", "de"]), r.choice(["src0", "src1", "src12"]), 0))
    return [*rows, (n, None, None, None, None), (n + 1, "", "en", "src0", 0)]


def lines_brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(BLANKS).translate(low)
    holds = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            holds[key(x)].add(d)
    gone = lambda x, d: len(key(x)) >= 20 and len(holds[key(x)]) >= 3 and d != max(holds[key(x)])
    out = []
    for d, t, lang, source, _ in rows:
        text = "\n".join(x for x in (t or "").split("\n") if not gone(x, d))
        out.append((d, text, lang, source, len(text)))
    return out


def simhash_brute(rows):
    fps = [(r[0], fingerprint(r[1])) for r in rows]
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [r for r in rows if find(r[0]) == r[0]]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output rows."""
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(corpus(), SCHEMA)
    docs.write.parquet(f"{d}/documents.parquet")
    out, docs = [], spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(C.STAGES):
        got = stage(spark, docs, d)
        if k + 1 < len(C.STAGES):
            assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got.write.parquet(f"{d}/{k}")
        after = spark.read.parquet(f"{d}/{k}")
        out.append((name, [tuple(r) for r in docs.collect()], after.collect()))
        docs = after
    return {name: (a, b) for name, a, b in out}, sorted(tuple(r.asDict().items()) for r in C.run(spark, d).drop("ids").collect())


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want) and want


def test_quality(stages):
    before, after = stages[0]["quality"]
    cut = quality.chi2(quality.LEVEL, quality.P) ** 0.5
    verdicts = brute_verdicts(before)
    same(after, [r for k, r in enumerate(before) if verdicts.get(k, 1e9) <= cut])
    assert all(brute_stats(r[1])[0] >= 50 for r in after) and len(after) < len(before)


def test_line_dedup(stages):
    before, after = stages[0]["line_dedup"]
    same(after, lines_brute(before))
    assert after != before


def test_simhash(stages):
    before, after = stages[0]["simhash"]
    same(after, simhash_brute(before))
    assert len(after) < len(before)


def test_mixing(stages):
    before, after = stages[0]["mixing"]
    taken = mix_brute(before, 0.9, 1, 7, mixing.WEIGHTS)
    assert {d for d, *_ in taken} == {r.doc_id for r in after} and set(taken.values()) == {1}
    by_id = {r[0]: r for r in before}
    same(after, [by_id[r.doc_id] for r in after])


def test_bpe(stages):
    from tokenizers import Tokenizer

    from heddle.llm.queries import tokenizer_path

    before, after = stages[0]["bpe"]
    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in after}
    assert len(got) == len(before)
    for d, text, *_ in before:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[d].ids == ids and got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_the_stages_one_after_another(stages):
    last = stages[0]["bpe"][1]
    assert stages[1] == sorted(tuple((k, v) for k, v in r.asDict().items() if k != "ids") for r in last)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
