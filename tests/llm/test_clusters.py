import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import clusters


def brute(ids, x, k, rounds, seed=3):
    """Lloyd rounds over Python's whole numbers."""
    order = sorted(range(len(ids)), key=lambda i: hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest())[:k]
    means = [[int(v) for v in x[i]] for i in order]

    def assign():
        out = []
        for row in x:
            d = [sum((int(a) - b) ** 2 for a, b in zip(row, m)) for m in means]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = assign()
        for c in range(len(means)):
            own = [x[i] for i, (g, _) in enumerate(got) if g == c]
            if own:
                means[c] = [int(sum(int(r[j]) for r in own)) // len(own) for j in range(len(x[0]))]
    return assign(), means


def test_cover_tree():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-500, 500, (300, 5)), np.repeat(rng.integers(-500, 500, (3, 5)), 60, axis=0), rng.integers(0, 4, (200, 5))])
    tree = clusters.Tree(x, leaf=4)
    assert sorted(tree.order) == list(range(len(x)))
    covered = np.zeros(len(x), int)
    for i in range(len(tree.center)):
        rows = tree.order[tree.start[i] : tree.end[i]]
        far = np.sqrt(clusters.squared(x[rows], x[tree.center[i]][None])[:, 0])
        assert far.max() == tree.radius[i]
        kids = range(tree.child[i], tree.child[i + 1])
        if not len(kids):
            assert len(rows) <= 4 or tree.radius[i] == 0
            covered[rows] += 1
            continue
        assert [tree.start[kids[0]], tree.end[kids[-1]]] == [tree.start[i], tree.end[i]]
        between = np.sqrt(clusters.squared(x[tree.center[kids]], x[tree.center[kids]]))
        assert all(tree.radius[k] <= tree.radius[i] / 2 for k in kids)
        assert (between[np.triu_indices(len(kids), 1)] > tree.radius[i] / 2).all()
    assert (covered == 1).all()


@pytest.mark.parametrize("spread", [3, 1000, 1 << 26])
def test_walk_is_exact_and_prunes(spread):
    rng = np.random.default_rng(spread)
    hubs = rng.integers(-spread, spread + 1, (6, 8))
    x = np.clip(hubs[rng.integers(0, 6, 900)] + rng.integers(-spread // 20 - 1, spread // 20 + 2, (900, 8)), -clusters.most(8), clusters.most(8))
    for k in (1, 2, 7, 40):
        means = np.concatenate([x[rng.integers(0, len(x), k)], x[:1], x[:1]])  # some are equal
        block = clusters.Block({k2: v for k2, v in clusters.Block.row(list(range(len(x))), x).items()}, 8)
        over = clusters.over_centroids(means)
        want = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(row, m)) for m in means] for row in block.x], object)
        nearest = [int(np.argmin(list(map(int, w)))) for w in want]
        assert block.assigned(means, over).tolist() == nearest
        count, total = block.sums(means, over)
        for c in range(len(means)):
            own = block.x[np.array(nearest) == c]
            assert count[c] == len(own) and (total[c] == own.sum(axis=0)).all()
    taken = [rows for rows, c in clusters.walked(block.x, block.tree, means[:2], clusters.over_centroids(means[:2])) if isinstance(c, int)]
    assert spread == 3 or sum(map(len, taken)) > len(x) / 2  # most are decided without looking at them


def test_matches_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(240, 4)), 3)
    v[200:] = v[0]  # many copies
    rows = [(i if i < 230 else 0, r.tolist(), "x") for i, r in enumerate(v)]
    rows[3] = (3, [2.0**17, -(2.0**17), 0.0, 1e-9], "x")
    odd = [(900, None, None), (901, [1.0, None, 0.0, 0.0], "x"), (902, [float("nan")] * 4, "x"), (903, [float("inf"), 0.0, 0.0, 0.0], "x"), (904, [1.0, 2.0], "x"), (905, [], "x"), (906, [1e300, 0.0, 0.0, 0.0], "x"), (None, [0.5, 0.5, 0.5, 0.5], "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cluster string").withColumn("distance", F.lit("clash"))
    got, means = clusters.clustered(df, k=5, rounds=4, dim=4, scale=100)
    kept = [*rows, odd[-1]]
    x = [[int(np.floor(100 * c)) for c in r[1]] for r in kept]
    named = [(r[0], y) for r, y in zip(kept, x)]
    first = sorted((n for n in named if n[0] is not None), key=lambda n: (hashlib.sha256(f"3:{n[0]}".encode()).hexdigest(), n[1]))
    ids = [n[0] for n in first] + [None]
    x = [n[1] for n in first] + [x[-1]]
    # seeds first, in the order of brute()'s stable sort
    want, centers = brute(ids, x, 5, 4)
    assert means.tolist() == centers
    table = clusters.report(got, means).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in table) == sorted((i is None, i or 0, c, d) for i, (c, d) in zip(ids, want))
    assert {r.inertia for r in table} == {sum(d for _, d in want)}
    for r in table:
        assert r.cluster_inertia == sum(d for c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()


def test_empty_and_few(spark):
    kind = "vec_id long, embedding array<float>"
    assert clusters.report(*clusters.clustered(spark.createDataFrame([], kind))).count() == 0
    few = clusters.report(*clusters.clustered(spark.createDataFrame([(1, [0.5]), (2, [-0.25])], kind), dim=1, k=8)).orderBy("vec_id").collect()
    assert sorted(r.cluster for r in few) == [0, 1] and {r.distance for r in few} == {0}


def test_query_is_brute_force(spark):
    from heddle.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows], float)).astype(int)
    want, _ = brute([r.vec_id for r in rows], x.tolist(), 8, 10)
    got = queries.op12_clusters(spark, "/root/testdata/sf0.001").orderBy("vec_id").collect()
    assert [(r.cluster, r.distance) for r in got] == want
