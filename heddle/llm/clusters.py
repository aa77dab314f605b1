"""Centroid clustering by dual-tree Lloyd rounds (operator 12).

Vectors become whole numbers, floor(scale * x), and are dealt by hash into blocks of some thousand; a task builds a cover tree
over each block once, a row a block, written to the shared folder. A node is one of a block's vectors and all that lie below it:
its radius reaches them, its children are farther apart than half of that, and it knows how many they are and their sums. A
round builds a tree over the k centroids and walks both together. A pair of nodes goes as soon as bounds on distances show that
every vector below has a nearer centroid; where one centroid is left for a node, all vectors below go to it by the node's sums;
what reaches the leaves is compared exactly, in whole numbers. A round sends one row of sums a task and centroid, and k rows of
sums to the driver, whatever the number of vectors.

Ties go to the smaller number. Means are exact floors. Centroids start as the k vectors of least sha256 of "seed:id"; empty ones
stay. Bounds are kept with a margin for rounding, so trees save comparisons and never change a result.

Vectors with another number of components than dim, null ones, and any with null or non-finite components are left out, as are
those with a component of floor(scale * x) beyond +-most(dim) (2^27 at 64 components), whose distances no long holds. An empty table gives no rows; fewer
vectors than k give as many centroids. Equal vectors and ids are rows each; a null id is no seed and stays null in the result.
Only the two columns named are read, whatever others there are. Sums of distances that no long holds are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Vectors of a leaf; vectors of a block.
LEAF, BLOCK = 24, 4096


def most(dim: int) -> int:
    """The largest component whose squared distances fit a long."""
    return isqrt((1 << 62) // dim) // 2


def suited(*arrays: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as floats where squared distances stay exact, which is faster, else as longs."""
    largest = max(int(np.abs(x).max(initial=0)) for x in arrays)
    return [x.astype(np.float64 if (2 * largest) ** 2 * x.shape[1] < 1 << 53 else np.int64) for x in arrays]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of y (whole numbers)."""
    x, y = suited(x, y)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)).astype(np.int64)


class Tree:
    """A cover tree over rows of x. Nodes are in breadth-first order; those below node i are rows start[i] to end[i] of order,
    its children nodes child[i] to child[i + 1]."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        (x,) = suited(x)
        center, radius, start, end, children = [], [], [], [], []
        level = [(0, 0, len(x), np.sqrt(squared(x, x[:1])[:, 0]))] if len(x) else []  # center, rows, distances to it
        while level:
            below = []
            for at, a, b, far in level:
                center.append(at)
                radius.append(far.max())
                start.append(a)
                end.append(b)
                own = self.split(x, at, a, b, far) if b - a > leaf and radius[-1] > 0 else []
                children.append(len(own))
                below += own
            level = below
        self.center, self.radius = np.array(center, np.int64), np.array(radius, float)
        self.start, self.end = np.array(start, np.int64), np.array(end, np.int64)
        self.child = np.concatenate([[1], 1 + np.cumsum(children)]).astype(np.int64)

    def split(self, x: np.ndarray, at: int, a: int, b: int, far: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
        """Children of a node: the first is its own center, each next the first row left over that half the radius of none reaches."""
        half, rows, out, parts, from_ = far.max() / 2, self.order[a:b].copy(), [], [], a
        own, left = x[rows], np.ones(len(rows), bool)
        norms = (own * own).sum(axis=1)
        while True:
            near = left & (far <= half)
            parts.append(rows[near])
            out.append((at, a, a + len(parts[-1]), far[near]))
            a += len(parts[-1])
            left &= ~near
            if a == b:
                self.order[from_:b] = np.concatenate(parts)
                return out
            i = int(left.argmax())
            at, far = rows[i], np.sqrt(norms - 2 * (own @ own[i]) + norms[i])


def over_centroids(means: np.ndarray) -> Tree:
    """A tree over the distinct centroids, one to a leaf; of equal ones the smallest number stands."""
    distinct, first = np.unique(means, axis=0, return_index=True)
    tree = Tree(distinct, leaf=1)
    tree.center = first[tree.center]
    return tree


def walked(x: np.ndarray, tree: Tree, means: np.ndarray, over: Tree) -> Iterator[tuple[np.ndarray, np.ndarray | int]]:
    """Rows of tree.order and the centroid of each: (a range of rows, one centroid) for a node decided as a whole, (rows, theirs)
    for leaves. over: over_centroids(means)."""
    leaf = (tree.child[1:] - tree.child[:-1]) == 0
    single = (over.end - over.start) == 1
    cx, cm = x[tree.center].astype(float), means[over.center].astype(float)
    wide = 1e-9 * (1 + max(np.abs(cx).max(initial=0), np.abs(cm).max(initial=0)) * np.sqrt(x.shape[1]))  # of roundings
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)  # live pairs, those of a node together
    while len(q):
        d = np.sqrt(((cx[q] - cm[r]) ** 2).sum(axis=1))
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(q))))
        # a centroid that is itself in hand bounds all below q by its distance; other nodes of centroids hold at least one within their radius
        best = np.minimum.reduceat(d + tree.radius[q] + over.radius[r], first)
        live = d - tree.radius[q] - over.radius[r] <= best[group] + wide
        q, r, group = q[live], r[live], group[live]
        count = np.bincount(group)
        whole = (count == 1)[group] & single[r]
        for i, c in zip(q[whole], over.center[r[whole]]):
            yield np.arange(tree.start[i], tree.end[i]), int(c)
        q, r, group = q[~whole], r[~whole], group[~whole]
        open_r = np.bincount(group, weights=~single[r], minlength=len(count))[group] > 0  # nodes of centroids go first
        last = ~open_r & leaf[q]
        if last.any():
            yield exact(x, tree, means, q[last], over.center[r[last]])
        by_r, by_q = open_r, ~open_r & ~leaf[q]
        grown = np.where(by_r[:, None] & ~single[r][:, None], np.stack([over.child[r], over.child[r + 1]], 1), np.stack([r, r + 1], 1))
        many = grown[:, 1] - grown[:, 0]
        nq, nr = np.repeat(q[by_r], many[by_r]), spread(grown[by_r])
        # q's children take all its pairs: sorted by the child, so that a child's pairs are together
        below = np.stack([tree.child[q[by_q]], tree.child[q[by_q] + 1]], 1)
        cq, cr = spread(below), np.repeat(r[by_q], below[:, 1] - below[:, 0])
        q, r = np.concatenate([nq, cq]), np.concatenate([nr, cr])
        sort = np.argsort(q, kind="stable")
        q, r = q[sort], r[sort]


def spread(ranges: np.ndarray) -> np.ndarray:
    """All numbers of the ranges (from, to), one after another."""
    n = ranges[:, 1] - ranges[:, 0]
    ends = np.cumsum(n)
    return np.arange(n.sum()) + np.repeat(ranges[:, 0] - (ends - n), n)


def exact(x: np.ndarray, tree: Tree, means: np.ndarray, q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the leaves q and the nearest of the centroids c that each leaf has left."""
    leaves, of = np.unique(q, return_inverse=True)
    allowed = np.zeros((len(leaves), len(means)), bool)
    allowed[of, c] = True
    ranges = np.stack([tree.start[leaves], tree.end[leaves]], 1)
    rows, which = spread(ranges), np.repeat(np.arange(len(leaves)), ranges[:, 1] - ranges[:, 0])
    d = squared(x[tree.order[rows]], means)
    d[~allowed[which]] = np.iinfo(np.int64).max
    return rows, d.argmin(axis=1)


class Block:
    """A block's vectors in the order of its tree, with sums that make any range of rows one subtraction."""

    SCHEMA = "ids array<long>, x binary, start array<long>, `end` array<long>, child array<long>, center array<long>, radius array<double>"

    def __init__(self, row: dict, dim: int):
        self.ids = row["ids"]
        self.x = np.frombuffer(row["x"], "<i4").reshape(-1, dim).astype(np.int64)
        self.tree = Tree.__new__(Tree)
        for name in ("start", "end", "child", "center", "radius"):
            setattr(self.tree, name, np.array(row[name], float if name == "radius" else np.int64))
        self.tree.order = np.arange(len(self.x))

    @staticmethod
    def row(ids: list[int | None], x: np.ndarray) -> dict:
        tree = Tree(x)
        place = np.empty(len(x), np.int64)
        place[tree.order] = np.arange(len(x))
        own = {k: getattr(tree, k) for k in ("start", "end", "child", "radius")} | {"center": place[tree.center]}
        return {"ids": [ids[i] for i in tree.order], "x": x[tree.order].astype("<i4").tobytes()} | own

    def assigned(self, means: np.ndarray, over: Tree) -> np.ndarray:
        """The centroid of each row."""
        out = np.full(len(self.x), -1, np.int64)
        for rows, c in walked(self.x, self.tree, means, over):
            out[rows] = c
        return out

    def sums(self, means: np.ndarray, over: Tree) -> tuple[np.ndarray, np.ndarray]:
        """(count, sum) of the rows of each centroid; nodes decided as a whole give those below in one step."""
        count, total = np.zeros(len(means), np.int64), np.zeros(means.shape, np.int64)
        upto = np.concatenate([np.zeros((1, self.x.shape[1]), np.int64), np.cumsum(self.x, axis=0)])
        for rows, c in walked(self.x, self.tree, means, over):
            if isinstance(c, int):
                count[c] += len(rows)
                total[c] += upto[rows[-1] + 1] - upto[rows[0]]
            else:
                np.add.at(count, c, 1)
                np.add.at(total, c, self.x[rows])
        return count, total


def whole(embedding: Column, scale: int, dim: int) -> Column:
    """floor(scale * x) of each component; null for another number of components, and where one is null, not finite or too large."""
    fine = (F.size(embedding) == dim) & F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double") * scale) <= most(dim), F.lit(False)))  # NaN is above all
    return F.when(fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def blocks(vectors: DataFrame, dim: int) -> DataFrame:
    """A row a block of vectors (vec_id, x), with its tree; written."""
    n = vectors.count()
    parts = max(2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK))

    def built(group: pa.Table) -> pa.Table:
        x = group.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.int64)
        return pa.Table.from_pylist([Block.row(group.column("vec_id").to_pylist(), x)], schema)

    longs = pa.list_(pa.int64())
    schema = pa.schema([("ids", longs), ("x", pa.binary()), *((k, longs) for k in ("start", "end", "child", "center")), ("radius", pa.list_(pa.float64()))])
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "x", F.monotonically_increasing_id()), F.lit(parts)))
    return written(dealt.groupBy("block").applyInArrow(built, Block.SCHEMA))


def rounded(held: DataFrame, means: np.ndarray) -> np.ndarray:
    """The means after one round: k rows for each component come to the driver, summed."""
    dim, over = means.shape[1], over_centroids(means)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(means), np.int64), np.zeros(means.shape, np.int64)
        for b in batches:
            for i in range(len(b)):
                n, sums = Block(b.slice(i, 1).to_pylist()[0], dim).sums(means, over)
                count, total = count + n, total + sums
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], ["c", "n", "sums"])

    parts = held.mapInArrow(of, "c long, n long, sums array<long>").select("c", "n", F.posexplode("sums").alias("at", "part"))
    found = parts.groupBy("c", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    out = means.copy()
    for r in found:  # k rows for each component
        out[r.c, r["at"]] = int(r.total) // int(r.n)
    return out


def clustered(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids (k rows of whole numbers)."""
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole(F.col(embedding), scale, dim).alias("x"))
    own = written(own.filter("x is not null"))
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = own.filter("vec_id is not null").orderBy(first, "x").limit(k).select("x").collect()  # k rows
    means = np.array([r.x for r in starts], np.int64).reshape(-1, dim)
    if not len(means):
        return own.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), means
    held = blocks(own, dim)
    for _ in range(rounds):
        means = rounded(held, means)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                block = Block(b.slice(i, 1).to_pylist()[0], dim)
                c = block.assigned(means, over)
                far = ((block.x - means[c]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(c.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    over = over_centroids(means)
    return held.mapInArrow(last, "vec_id long, cluster int, distance long"), means


def report(assigned: DataFrame, means: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia and the sha256 of the cluster's centroid; k rows are broadcast."""
    spark = assigned.sparkSession
    names = [(i, hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for i, m in enumerate(means.tolist())]
    of = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    rows = written(assigned)
    each = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_own"))
    every = each.agg(F.sum("_own").alias("_all"))  # one row
    sums = each.crossJoin(F.broadcast(every)).join(of, "cluster").select("cluster", F.col("_own").try_cast("long").alias("cluster_inertia"), F.col("_all").try_cast("long").alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """DuckDB SQL of the same rows over the table embeddings: every vector against every centroid, round by round."""
    ctes = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, x AS m FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, x, first(c ORDER BY d, c) AS c, min(d) AS d FROM (SELECT vec_id, x, c, list_sum(list_transform(range(1, {dim + 1}), lambda j: (x[j] - m[j]) * (x[j] - m[j])))::BIGINT AS d
  FROM v, m{i}) GROUP BY vec_id, x)"""
        )
        if i < rounds:
            ctes.append(
                f"""m{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM m{i} o LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM
  (SELECT c, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {dim + 1})) AS j) GROUP BY c, j) GROUP BY c) n USING (c))"""
            )
    return f"""WITH {", ".join(ctes)} SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN m{rounds} USING (c)"""
