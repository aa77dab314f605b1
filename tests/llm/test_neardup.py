from decimal import Decimal

import math
from collections import Counter

import numpy as np
import pytest

from heddle.llm import neardup as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    good = [(i, v, lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root = {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in range(len(good)):
        x = np.array(good[a][1], np.float64)
        for b in range(a):
            if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]):
                y = np.array(good[b][1], np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(good[a][0]), find(good[b][0])
                    root[max(p, q)] = min(p, q)
    at = {id(g): k for k, g in enumerate(good)}
    return Counter((r[0], links[at[id(r)]] if id(r) in at else 0, None if r[0] is None else find(r[0])) for r in [next((g for g in good if g[0] == r[0] and g[1] is r[1] and g[2] == r[2]), r) for r in rows])


def vectors(dim=64, seed=1):
    r = np.random.default_rng(seed)
    f = lambda x: [float(v) for v in np.float32(x)]
    rows, i = [], 0
    for group, spread in [(60, 0.05), (30, 0.11), (25, 0.13), *[(1, 0)] * 150, *[(2, 0.18)] * 60]:
        base = r.normal(size=dim)
        base /= np.linalg.norm(base)
        lab = int(r.integers(0, 3))
        for _ in range(group):
            z = r.normal(size=dim)
            rows.append((i, f((base + spread * z / np.linalg.norm(z)) * r.uniform(0.1, 50)), lab))
            i += 1
    for k in range(12):
        rows.append((i + k, rows[0][1], rows[0][2]))
    i += 12
    odd = [(i, None, 1), (i + 1, [], 1), (i + 2, [0.0] * dim, 1), (i + 3, f([np.nan] + [1] * (dim - 1)), 1), (i + 4, f([np.inf] + [1] * (dim - 1)), 1), (i + 5, rows[0][1], None), (i + 6, [None] + [1.0] * (dim - 1), 1), (None, rows[0][1], rows[0][2]), (i + 7, [1.0, 2.0, 3.0], 1), (i + 8, [2.0, 4.0, 6.0], 1), (i + 9, [-5.0], 1), (i + 10, [-1.0], 1)]
    return rows + odd


@pytest.mark.parametrize("block", [512, 7])
def test_against_brute_force(spark, block):
    rows = vectors()
    got = N.linked(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    want = brute(rows)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_recall_at_the_threshold():
    r = np.random.default_rng(5)
    x = N.unit(r.normal(size=(4000, 64)))
    z = r.normal(size=x.shape)
    z = N.unit(z - (z * x).sum(1, keepdims=True) * x)
    a, b = N.codes(x), N.codes(0.98 * x + math.sqrt(1 - 0.98**2) * z)
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.998


def test_empty_table(spark):
    assert N.linked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_query_and_its_sql(spark, tmp_path):
    import duckdb

    from heddle.llm import queries

    rows = [r for r in vectors(seed=4) if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    sql = con.sql(queries.ORACLES["op7_neardup"])
    got = queries.op7_neardup(spark, str(tmp_path))
    columns = sorted(got.columns)
    assert sorted(sql.columns) == columns
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(sql.select(*columns).fetchall())
    assert sum(r.n_links > 0 for r in got.collect()) > 100


def test_double_precision_and_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 1, 5), (2, [1.0, 1e-9], 1, 6), (3, [0.0, 1.0], 1, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int").withColumns({"key": N.F.lit(1), "cid": N.F.lit(2), "n": N.F.lit(3)})
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in N.linked(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_labels_of_any_type(spark):
    import warnings

    rows = [(i, [1.0, 0.0, 0.01 * i]) for i in range(6)]
    for kind, labels in (("double", [1.2, 1.2, 1.7, 1.7, 2.0, None]), ("string", ["a", "a", "b", "b", "1", None]), ("boolean", [True, True, False, False, None, None]), ("decimal(5,2)", [*map(Decimal, ("1.20", "1.2", "1.7", "1.70", "2"))] + [None])):
        df = spark.createDataFrame([(*r, x) for r, x in zip(rows, labels)], f"vec_id long, embedding array<double>, label {kind}")
        got = {r.vec_id: (r.n_links, r.component_id) for r in N.linked(df).collect()}
        assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4), 5: (0, 5)}, kind
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert N.buckets(N.unit(np.ones((2, 4))), -(1 << 63)).shape == (2, N.TABLES, N.PROBES)
