"""Near-duplicate vectors by cross-polytope hashing (operator 7).

A hash rotates a unit vector (three rounds of random signs and a fast Hadamard transform, padded with zeros to a power of
two) and takes the axis nearest to it, of 2 x dimension. A table joins several hashes into one bucket; each vector is put in
its probes best buckets of each table. Vectors of one bucket, label and dimension are compared exactly, in double precision.

Equal vectors of a label are one class before that, known by 128 bits of hash. Buckets are first counted without their vectors;
vectors only go to buckets that two or more classes share, as they came (single precision stays that on the way). Buckets of
more than block classes are cut into blocks and compared block by block in many tasks, so that no task holds a whole bucket and
no row is made for a pair: a task adds up links and gives the edges of a spanning forest. A pair that shares several buckets
counts in the least of them only. A bucket of n classes costs n * n comparisons, as all its links are counted.

Labels may be of any type and are compared as text; tasks know them by 64 bits of hash. An empty table gives no rows; other columns are not read, whatever their names. Null labels and ids, and vectors that are null, empty, zero or hold null or non-finite components link with nothing (such
rows are their own component; without an id, null and not kept). Rows of equal id are vectors each. At cosine 0.98 and 64
dimensions the defaults miss about one pair in ten thousand; tests measure recall against brute force.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, salted_join, written

TABLES, HASHES, PROBES, NEXT = 4, 3, 4, 3  # NEXT: axes considered for each hash


def hadamard(x: np.ndarray) -> np.ndarray:
    """Of each row; the number of columns is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(maxsize=64)
def signs(dim: int, table: int, which: int) -> np.ndarray:
    return np.random.default_rng([97, dim, table, which]).choice([-1.0, 1.0], size=(3, dim))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component goes first, so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray) -> np.ndarray:
    """(rows, TABLES, PROBES) buckets of unit vectors; the table is part of the code."""
    dim = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    combos = np.array([*itertools.product(range(min(NEXT, dim)), repeat=HASHES)])
    out = []
    for t in range(TABLES):
        code, loss = np.zeros((len(x), len(combos)), np.int64), np.zeros((len(x), len(combos)))
        for k in range(HASHES):
            r = x
            for s in signs(dim, t, k):
                r = hadamard(r * s)
            far = np.abs(r)
            axes = np.argsort(-far, axis=1, kind="stable")[:, : min(NEXT, dim)]
            size = np.take_along_axis(far, axes, 1)
            axis = 2 * axes + (np.take_along_axis(r, axes, 1) < 0)
            code = code * (2 * dim) + axis[:, combos[:, k]]
            loss += (size[:, :1] - size)[:, combos[:, k]] ** 2
        best = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        out.append(np.take_along_axis(code, best, 1) * TABLES + t)
    return np.stack(out, axis=1)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def buckets(x: np.ndarray, label: int) -> np.ndarray:
    """The same with the label mixed in: 64 bits for each row, table and probe."""
    mixed = codes(x).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(label * 0xD1B54A32D192ED03 % (1 << 64))
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def bucketed(classes: DataFrame) -> DataFrame:
    """(key, cid, node) of each class and bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = np.stack([b.column("dim").to_numpy().astype(np.int64), b.column("label").to_numpy()])
            for dim, label in np.unique(kinds, axis=1).T.tolist():
                some = b.take(pa.array(np.flatnonzero((kinds[0] == dim) & (kinds[1] == label))))
                found = buckets(unit(matrix(some.column("v"), dim)), label).reshape(len(some), -1)
                row = pa.array(np.repeat(np.arange(len(some)), found.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), some.column("cid").take(row), some.column("node").take(row)], ["key", "cid", "node"])

    return classes.select("label", "dim", "cid", "node", "v").mapInArrow(of, "key long, cid long, node long")


class Block:
    """Compares the rows of groups that came together; links() gives what they add."""

    def __init__(self, label: int, threshold: float):
        self.label, self.threshold = label, threshold
        self.rows: list[np.ndarray] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def compare(self, key: int, v: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> int:
        """a, b: rows of two blocks, or of one."""
        at = self.held
        self.rows.append(v)
        self.held += len(v)
        if b is None:
            x, y = np.nonzero(np.triu(v @ v.T >= self.threshold, 1))
        else:
            x, y = np.nonzero(v[a] @ v[b].T >= self.threshold)
            x, y = a[x], b[y]
        if len(x):
            self.pairs.append((x + at, y + at, np.full(len(x), key)))
        return len(x)

    def links(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that are linked, the links that each has here, and a row each is connected to."""
        if not self.pairs:
            return (np.zeros(0, np.int64),) * 3
        x, y, key = map(np.concatenate, zip(*self.pairs))
        used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
        x, y = back[: len(x)], back[len(x) :]
        code = buckets(np.concatenate(self.rows)[used], self.label)
        most = np.iinfo(np.int64).max
        first = np.full(len(x), most)
        for t in reversed(range(TABLES)):  # the least common bucket, tables in order
            least = np.full(len(x), most)
            for i, j in itertools.product(range(code.shape[2]), repeat=2):
                least = np.minimum(least, np.where(code[x, t, i] == code[y, t, j], code[x, t, i], most))
            first = np.where(least < most, least, first)
        own = first == key
        x, y = x[own], y[own]
        got = np.bincount(x, n[used[y]], len(used)) + np.bincount(y, n[used[x]], len(used))
        root = np.arange(len(used))
        while True:
            least = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, x, least)
            np.minimum.at(new, y, least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        live = got > 0
        return used[live], got[live].astype(np.int64), used[root[live]]


def compared(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (label, dim, key, bi, bj, block, cid, node, n, v), those of a group together -> (cid, node, links, other)."""
    kinds = "cid long, node long, links long, other long"
    group = ["label", "dim", "key", "bi", "bj"]

    def done(b: pa.RecordBatch) -> pa.RecordBatch:
        """Of whole groups."""
        g = np.stack([b.column(c).to_numpy().astype(np.int64) for c in group])
        starts = np.flatnonzero(np.concatenate([[True], (g[:, 1:] != g[:, :-1]).any(axis=0)]))
        ends = np.append(starts[1:], len(b))
        block, n = b.column("block").to_numpy(), b.column("n").to_numpy()
        cid, node = b.column("cid").to_numpy(), b.column("node").to_numpy()
        out: list[list[np.ndarray]] = [[], [], [], []]
        many = ends - starts > 1
        for label, dim in np.unique(g[:2, starts[many]], axis=1).T.tolist():
            work, took = Block(label, threshold), []
            own = many & (g[0, starts] == label) & (g[1, starts] == dim)

            def flush() -> None:
                at = np.concatenate(took)
                row, links, other = work.links(n[at])
                for o, v in zip(out, (cid[at[row]], node[at[row]], links, node[at[other]])):
                    o.append(v)

            pairs = 0
            for s, e in zip(starts[own], ends[own]):
                v = unit(matrix(b.column("v").slice(s, e - s), dim))
                one = g[3, s] == g[4, s]
                pairs += work.compare(int(g[2, s]), v, np.flatnonzero(block[s:e] == g[3, s]), None if one else np.flatnonzero(block[s:e] == g[4, s]))
                took.append(np.arange(s, e))
                if pairs > 200_000:
                    flush()
                    work, took, pairs = Block(label, threshold), [], 0
            if took:
                flush()
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64)) for o in out], ["cid", "node", "links", "other"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not len(b):
                continue
            g = np.stack([b.column(c).to_numpy().astype(np.int64) for c in group])
            ends = np.flatnonzero((g[:, 1:] != g[:, :-1]).any(axis=0))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # where the last group begins
            if held and (g[:, 0] != last).any():
                yield done(joined(held))
                held = []
            if cut:
                yield done(joined([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
            last = g[:, -1]
        if held:
            yield done(joined(held))

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return rows.mapInArrow(of, kinds)


def usable(label: Column, v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & fine, F.lit(False))


def linked(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98, block: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors."""
    v, name = F.col(embedding), F.col(label).cast("string")
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), name.alias("name"), F.when(name.isNotNull(), F.xxhash64(name)).alias("label"))
    fine = F.col("vec_id").isNotNull() & usable(F.col("label"), F.col("v"))
    own = own.withColumns({"cid": F.when(fine, F.xxhash64("name", "v")), "cid2": F.when(fine, F.xxhash64(F.lit("second"), "name", "v"))})
    classes = own.filter("cid is not null").groupBy("name", "label", "v", "cid", "cid2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("dim", F.size("v")))
    narrow = written(bucketed(classes))
    shared = narrow.groupBy("key").count().filter("count > 1").select("key", F.ceil(F.col("count") / block).cast("int").alias("g"))
    rows = salted_join(narrow, shared, ["key"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid", "node"), F.col("g")).cast("int"))
    rows = rows.join(classes.select("cid", "node", "label", "dim", "n", "v"), ["cid", "node"])
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("label", "dim", "key", F.least("block", "_with").alias("bi"), F.greatest("block", "_with").alias("bj"), "block", "cid", "node", "n", "v")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "label", "dim", "key", "bi", "bj").sortWithinPartitions("label", "dim", "key", "bi", "bj")
    found = written(compared(rows, threshold))
    sums = found.groupBy("cid", "node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    out = classes.select("cid", "cid2", "node", "n").join(sums, ["cid", "node"], "left").join(parts, "node", "left")
    out = out.select("cid", "cid2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = own.select("vec_id", "cid", "cid2").join(out, ["cid", "cid2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= CAST(0.98 AS DOUBLE)),
r AS (SELECT vec_id AS id, vec_id AS reach FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT id AS vec_id, (SELECT count(*) FROM l WHERE l.a = id) AS n_links, component_id, id = component_id AS kept FROM c
"""
