import math

import numpy as np
from pyspark.sql import functions as F

from heddle.llm import negatives


def brute(rows, is_anchor, positives=5, many=3, low=50, high=95, scale=256):
    """rows (id, label, vector), over Python's whole numbers."""
    kept = [(i, lab, [math.floor(scale * c) for c in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) and abs(c) < 1e6 for c in v)]
    out = []
    for a, lab, x in kept:
        if not is_anchor(a):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, other == lab) for i, other, y in kept if len(y) == len(x)]
        for s, i in sorted((s, i) for s, i, same in scored if same and i != a)[:positives]:
            fine = sorted((t, j) for t, j, same in scored if not same and low * -s <= 100 * -t <= high * -s)[:many]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(fine)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def made(n, seed, dim=6, labels=3, coarse=None):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) + 0.8
    v = np.round(v * coarse) / coarse if coarse else v
    return [(i, str(rng.integers(0, labels)), x.tolist()) for i, x in enumerate(v)]


def test_ties_copies_and_odd_rows(spark):
    rows = made(300, 1, coarse=1)  # whole components: scores tie often
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(80)] + [(2000 + i, "9", rows[5][2]) for i in range(80)] + [rows[7], rows[50], rows[50]]
    rows += [(50, "0", None), (100, None, [1.0] * 6), (150, "1", [1.0, None, 0.0, 0.0, 0.0, 0.0]), (200, "1", [float("nan")] * 6), (250, "1", [float("inf")] + [0.0] * 5)]
    rows += [(350, "1", [1.0, 2.0]), (301, "1", [2.0, 2.0]), (302, "0", [1.5, 1.0]), (400, "1", []), (401, "1", []), (402, "2", []), (None, "1", [1.0] * 6), (450, "1", [1e300] + [0.0] * 5), (500, "2", [0.0] * 6), (501, "2", [-3.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").withColumns({"id": F.lit("clash"), "x": F.lit(1), "at": F.lit(2)})
    got = rows_of(negatives.hard_negatives(df, F.col("id") % 50 == 0, F.col("label")))
    assert got == brute(rows, lambda i: i % 50 == 0)
    assert any(r[0] == 350 for r in got) and any(r[0] == 50 for r in got)


def test_long_scores_many_passes_small_blocks(spark):
    rows = made(250, 2, labels=2)
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    for scale, k, m, digit in ((1 << 24, 3, 4, 9), (16, 1, 40, 3)):
        got = rows_of(negatives.hard_negatives(df, F.col("id") % 25 == 0, F.col("label"), positives=k, negatives=m, scale=scale, low=10, high=99, digit=digit, each=4))
        assert got == brute(rows, lambda i: i % 25 == 0, k, m, 10, 99, scale)


def test_empty(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert negatives.hard_negatives(spark.createDataFrame([], kind), F.col("id") % 50 == 0, F.col("label")).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], kind)
    assert negatives.hard_negatives(one, F.col("id") % 50 == 0, F.col("label")).count() == 0


def test_query_is_brute_force(spark):
    from heddle.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    assert rows_of(queries.op11_negatives(spark, "/root/testdata/sf0.001")) == brute(rows, lambda i: i % 50 == 0)
