import random

import numpy as np
import xxhash

from heddle.llm import queries, simhash


def plain(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(rows):
    """doc_id -> smallest doc_id reachable."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, f) in enumerate(rows):
        for b, g in rows[:i]:
            if (f ^ g).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d, _ in rows}


def test_fingerprint():
    for t in (None, "", " \n", "One", "a b c", "A b c D e f g É", "x\x1cy z　w q", "w " * 5000, "Lorem ipsum dolor sit amet, consectetur. " * 9):
        assert simhash.fingerprint(t) == plain(t)


def test_golay():
    v = np.arange(1 << 23)
    n = simhash.nearest(v)
    assert (np.bincount(n) == 2048).all()


def test_keys_meet():
    r = random.Random(5)
    for _ in range(60):
        a = r.getrandbits(64)
        bs = [a] + [a ^ sum(1 << k for k in r.sample(range(64), e)) for e in (1, 2, 3, 4) for _ in range(20)]
        found = simhash.keys(np.array(bs, np.uint64))
        sets = {s: [set() for _ in bs] for s in found}
        for s, (rows, ks) in found.items():
            for i, k in zip(rows.tolist(), ks.tolist()):
                sets[s][i].add(k)
        for i in range(len(bs)):
            assert sets["of"][0] & sets["ask"][i] or sets["both"][0] & sets["both"][i]


def test_linked(spark):
    r = random.Random(3)
    rows, d = [(0, 0), (1, 0), (2, 0b1111), (3, 0b111111111)], 4
    for _ in range(25):
        f = r.getrandbits(64)
        for _ in range(r.choice((1, 2, 25))):
            rows.append((d, f))
            d += 1
            f ^= sum(1 << k for k in r.sample(range(64), r.randint(0, 5)))
    r.shuffle(rows)
    df = spark.createDataFrame([(a, f - (1 << 64) if f >> 63 else f) for a, f in rows] + [(None, 0), (None, 77)], "doc_id long, fp long")
    got = {x.fp & (1 << 64) - 1: x.component_id for x in simhash.linked(df).collect()}
    want = brute(rows)
    assert {a: got[f] for a, f in rows} == want
    assert set(got) == {f for _, f in rows}  # 77 is that of a row without doc_id alone


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = {x.doc_id: x for x in queries.op9_simhash(spark, d).collect()}
    fps = [(x.doc_id, plain(x.text)) for x in docs]
    assert {a: got[a].fingerprint for a, _ in fps} == {a: f"{f:016x}" for a, f in fps}
    assert {a: got[a].component_id for a, _ in fps} == brute(fps)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, ""), (None, "alone here now yes"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    got = sorted(((x.doc_id, x.component_id) for x in simhash.components_of(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 1), (None, None), (3, 3), (3, 3)], key=str)
    assert simhash.components_of(df.limit(0)).count() == 0


def near_one(n, seed=9):
    """n fingerprints within 6 bits of one."""
    r, out, middle = random.Random(seed), set(), random.Random(1).getrandbits(64)
    while len(out) < n:
        out.add(middle ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))))
    return [*out]


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_large_keys(spark):
    """Keys that are widened, and cut into blocks, lose no link."""
    r = random.Random(4)
    fps = near_one(250)
    a = r.getrandbits(21)  # one first segment for all, others apart
    fps += [a | r.getrandbits(43) << 21 for _ in range(60)]
    fps += [f ^ sum(1 << k for k in r.sample(range(64), e)) for f in fps[-60:] for e in (4, 5)]
    rows = [*enumerate(dict.fromkeys(fps))]
    df = spark.createDataFrame([(d, signed(f)) for d, f in rows], "doc_id long, fp long")
    want = brute(rows)
    for block in (3, 40, 4096):
        got = {x.fp & (1 << 64) - 1: x.component_id for x in simhash.linked(df, block=block).collect()}
        assert {d: got[f] for d, f in rows} == want


def test_rows_grow_with_rows(spark):
    """Of a dense group, rows to compare; rows of what is found are fewer."""
    made, found = [], []
    for n in (1000, 2000, 4000):
        df = spark.createDataFrame([(signed(f), d) for d, f in enumerate(near_one(n))], "fp long, part long")
        rows = simhash.written(simhash.dealt(df, 4096))
        made.append(rows.count())
        found.append(simhash.united(rows, 4).count())
    assert made[1] < 2.2 * made[0] and made[2] < 2.2 * made[1]
    assert all(f < m for f, m in zip(found, made))
