"""Hard-negative mining by distributed radix selection (operator 11).

Scores are exact inner products of whole numbers, floor(scale * x). An ask is an anchor, the window of scores that count, whether
rows of its own label are asked for or others, and how many of the best. Positives are one ask an anchor over all scores; each
positive then gives a window, and so one ask more, for its negatives.

selected() answers all asks at once. Rows and anchors are dealt into blocks, and a task has one block of each. A pass cuts every
ask's window into at most 2^digit buckets by the highest digit of the score that is still open; tasks count their rows a bucket,
Spark adds the histograms up, and the bucket that holds the kth best score becomes the window of the next pass, with what is above
it taken from k. So after a few passes each ask knows the kth score exactly, and only then rows are gathered: those above it, fewer
than k, and of those that tie with it the k smallest ids of each task. A task leaves out buckets below its own kth row, which
cannot hold the kth of all. No pair of rows is ever a Spark row but for these; what a task holds is bounded by the blocks.

Rows with a null label, id or vector, or with a null or non-finite component, take no part, nor do those with a whole number beyond
+-largest(number of components), whose scores no long holds. Vectors of another length than the anchor's are not compared with it.
Labels are compared as text and may be of any type. Ties go by id; rows of an anchor's own id are not its positives. Rows of equal
id are rows each, and so are anchors. An empty table gives no rows. Only the columns named are read, whatever others there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bits of a pass; rows and anchors of a block; anchors whose scores a task holds at a time.
DIGIT, ROWS, ANCHORS, HELD = 10, 16384, 8192, 64


def largest(dim: Column) -> Column:
    """The largest component whose scores fit a long."""
    return F.floor(F.sqrt(F.lit(float(1 << 61)) / F.greatest(dim, F.lit(1))))


def prepared(vectors: DataFrame, label: Column, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(id, label, x, dim, at) of the rows that take part, at a number of the row's own. Written."""
    v = F.col(embedding)
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double") * scale) <= largest(F.size(v)), F.lit(False)))  # NaN is above all
    x = F.when(fine, F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), label.cast("string").alias("label"), x.alias("x"))
    rows = rows.filter("id is not null and label is not null and x is not null").withColumn("dim", F.size("x"))
    return written(rows.withColumn("at", F.monotonically_increasing_id()))


def dealt(df: DataFrame, name: str, key: str, blocks: int) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))


class Grid:
    """The rows and the anchors in blocks, so that every pair of blocks is one group. digit: bits of a pass."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, digit: int = DIGIT, each: int = ANCHORS):
        self.digit = digit
        n, a = rows.count(), anchors.count()
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.across = max(2 * parts, -(-n // ROWS))
        self.down = max(1, -(-a // each))
        self.rows = dealt(rows, "rb", "at", self.across)
        self.anchors = dealt(anchors, "ab", "at", self.down)

    def groups(self, asks: DataFrame) -> tuple:
        """asks (at, w, lo, hi, k) with their anchors, an array an anchor, beside every block of rows."""
        own = asks.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("w", "lo", "hi", "k"))).alias("asks"))  # as many as an anchor has positives
        own = self.anchors.join(own, "at").withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(self.across - 1))))
        rows = self.rows.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(self.down - 1))))
        keys = ("dim", "rb", "ab")
        return rows.select(*keys, "id", "label", "x").groupBy(*keys).cogroup(own.select(*keys, "at", "id", "label", "x", "asks").groupBy(*keys))


def numbers(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; by floats where these are exact."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1] < 1 << 53:
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    return x @ y.T


def each_anchor(rows: pa.Table, anchors: pa.Table, same: bool):
    """(row of anchors, rows of the asked kind, their scores) of a group; HELD anchors are scored at a time."""
    dim = rows.column("dim")[0].as_py() if len(rows) else 0
    if not len(rows) or not len(anchors):
        return
    names, codes = np.unique(np.array(rows.column("label").to_pylist() + anchors.column("label").to_pylist(), object).astype(str), return_inverse=True)
    mine, theirs = codes[: len(rows)], codes[len(rows) :]
    ids, own = rows.column("id").to_numpy(), anchors.column("id").to_numpy()
    x, y = numbers(rows.column("x"), dim), numbers(anchors.column("x"), dim)
    for a in range(0, len(anchors), HELD):
        s = scores(y[a : a + HELD], x)
        for i in range(len(s)):
            kind = (mine == theirs[a + i]) & (ids != own[a + i]) if same else mine != theirs[a + i]
            at = np.flatnonzero(kind)
            yield a + i, at, s[i, at]


def shift(lo: int, hi: int, digit: int) -> int:
    """Bits of the score below this pass's digit."""
    return max(0, (hi - lo).bit_length() - digit)


def histograms(grid: Grid, asks: DataFrame, same: bool) -> DataFrame:
    """(at, w, bucket, n): rows of each bucket, counted from the window's lower end; a row for each of few buckets and task."""

    digit = grid.digit

    def count(key, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        ats, wants = anchors.column("at").to_pylist(), anchors.column("asks").to_pylist()
        for a, _, s in each_anchor(rows, anchors, same):
            for ask in wants[a]:
                lo, hi = ask["lo"], ask["hi"]
                bucket = (s[(s >= lo) & (s <= hi)] - lo) >> shift(lo, hi, digit)
                n = np.bincount(bucket)
                above = np.cumsum(n[::-1])[::-1]  # rows of a bucket and those above
                kept = np.flatnonzero((n > 0) & (above - n < ask["k"]))
                out += [(ats[a], ask["w"], b, c) for b, c in zip(kept.tolist(), n[kept].tolist())]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 4, names=["at", "w", "bucket", "n"])

    found = grid.groups(asks).applyInArrow(count, "at long, w long, bucket long, n long")
    return found.groupBy("at", "w", "bucket").agg(F.sum("n").alias("n"))


def narrowed(asks: DataFrame, counts: DataFrame, digit: int) -> DataFrame:
    """asks whose window is the bucket of the kth best score, k less what is above; unchanged but for short where fewer than k are there.

    bits: those of the score still open."""
    by = Window.partitionBy("at", "w").orderBy(F.desc("bucket"))
    counts = counts.withColumn("upto", F.sum("n").over(by))
    kth = counts.join(asks.select("at", "w", "k"), ["at", "w"]).filter("upto >= k and upto - n < k").select("at", "w", "bucket", (F.col("upto") - F.col("n")).alias("above"))
    out = asks.join(kth, ["at", "w"], "left")
    some = F.col("bucket").isNotNull()
    step = F.expr(f"shiftleft(1L, greatest(0, bits - {digit}))")
    lo = F.col("lo") + F.col("bucket") * step
    return out.select(
        "at", "w", F.when(some, lo).otherwise(F.col("lo")).alias("lo"), F.when(some, F.least(lo + step - 1, F.col("hi"))).otherwise(F.col("hi")).alias("hi"),
        F.when(some, F.col("k") - F.col("above")).otherwise(F.col("k")).alias("k"), (~some).alias("short"), "top", "most",
    )


def open_bits(asks: DataFrame) -> DataFrame:
    """asks with bits, how many it takes to write hi - lo."""
    return asks.withColumn("bits", F.when(F.col("hi") > F.col("lo"), F.length(F.bin(F.col("hi") - F.col("lo")))).otherwise(0))


def selected(grid: Grid, asks: DataFrame, same: bool) -> DataFrame:
    """asks (at, w, lo, hi, k) -> (at, w, rank, id, score): of the rows of each ask, the k of highest score, ties by smaller id.

    The number of passes follows from the widest window, at most seven of ten bits; each adds up the histograms in one shuffle."""
    asks = written(open_bits(asks.filter("lo <= hi").select("at", "w", "lo", "hi", "k", F.lit(False).alias("short"), F.col("hi").alias("top"), F.col("k").alias("most"))))
    done = []
    while True:
        settled = F.col("short") | (F.col("bits") == 0)
        done.append(asks.filter(settled))
        asks = asks.filter(~settled)
        if asks.isEmpty():
            break
        asks = written(open_bits(narrowed(asks, histograms(grid, asks.select("at", "w", "lo", "hi", "k"), same), grid.digit)))
    ends = done[0]
    for more in done[1:]:
        ends = ends.unionByName(more)

    def gather(key, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        ats, wants = anchors.column("at").to_pylist(), anchors.column("asks").to_pylist()
        ids = rows.column("id").to_numpy()
        for a, at, s in each_anchor(rows, anchors, same):
            for ask in wants[a]:
                least, top, k = ask["lo"], ask["hi"], ask["k"]
                took = np.flatnonzero((s >= least) & (s <= top))
                if len(took) > k:
                    took = took[np.lexsort((ids[at[took]], -s[took]))[:k]]
                if len(took):
                    out.append((np.full(len(took), ats[a]), np.full(len(took), ask["w"]), ids[at[took]], s[took]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)] or [pa.array([], pa.int64())] * 4, names=["at", "w", "id", "score"])

    wanted = ends.select("at", "w", "lo", F.col("top").alias("hi"), F.col("most").alias("k"))
    found = grid.groups(wanted).applyInArrow(gather, "at long, w long, id long, score long").join(wanted.select("at", "w", "k"), ["at", "w"])
    place = F.row_number().over(Window.partitionBy("at", "w").orderBy(F.desc("score"), "id"))  # k rows a task and ask
    return found.withColumn("rank", place).filter("rank <= k").select("at", "w", "rank", "id", "score")


def hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    vec_id: str = "vec_id", embedding: str = "embedding", digit: int = DIGIT, each: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: a condition on the column id, of the rows that are asked for. An anchor's positives are its best other rows of its label; for
    each, the best rows of other labels with low * positive <= 100 * negative <= high * positive (percentages, low <= high)."""
    rows = prepared(vectors, label, vec_id, embedding, scale)
    asked = written(rows.filter(anchors).select("at", "id", "label", "x", "dim"))
    grid = Grid(rows, asked, digit, each)
    # no score is beyond the product of two vectors' lengths; one row
    square = F.aggregate("x", F.lit(0.0).cast("double"), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    reach = rows.agg(F.ceil(F.sqrt(F.max(square)) * (1 + 1e-9)).alias("reach")).first().reach or 0
    bound = F.least(F.ceil(F.sqrt(square) * (1 + 1e-9) * float(reach)) + 1, F.lit((1 << 62) - 1)).cast("long")
    first = asked.select("at", F.lit(0).cast("long").alias("w"), (-bound).alias("lo"), bound.alias("hi"), F.lit(positives).cast("long").alias("k"))
    best = written(selected(grid, first, same=True))
    whole = lambda c: c.cast("decimal(38,0)")
    score = whole(F.col("score"))
    asks = best.select(
        "at", F.col("rank").cast("long").alias("w"), F.ceil(score * low / 100).cast("long").alias("lo"), F.floor(score * high / 100).cast("long").alias("hi"), F.lit(negatives).cast("long").alias("k")
    )
    found = selected(grid, asks, same=False)
    pos = best.select("at", F.col("rank").cast("long").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(pos, ["at", "w"]).join(asked.select("at", F.col("id").alias("anchor_id")), "at")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(label: str = "label", vec_id: str = "vec_id") -> Column:
    """The label of the registered query: every seventh row's is the next of ten."""
    return F.when(F.col(vec_id) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.id % 50 = 0 AND len(a.x) = len(b.x) AND a.id <> b.id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS place
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
"""
