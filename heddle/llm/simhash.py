"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 9).

Fingerprints link at 4 or fewer differing bits of 64. They are cut into segments of 21, 21 and 22 bits, so that two of the
three differ in 2 bits or fewer together: in at most one bit each, or in none and two. A segment's keys are the indices of
the Golay codewords nearest to it and to each of its one-bit neighbours (six at most); segments within two bits share one.
- one bit each: the first text gives its two nearest codewords, the second all pairs of its keys;
- none and two: both give the first segment as it is and the keys of the second.
Rows of equal key are joined and every pair verified. No pair within 4 bits is missed.

Null and empty texts and those without words have fingerprint 0 and link as any other; texts of fewer words than a shingle are one
shingle; very long texts are read whole, a part of their shingles at a time; rows that repeat count once a fingerprint; an empty
table gives no rows; other columns are not read but by dedup(), which keeps them, whatever their names.

Rows of a key are compared where they lie, in a task, which gives the edges of a spanning forest; no row is made for a pair. Keys
of more than `block` rows (24 bits a pair of segments get there by chance in large tables) are widened by the third segment's keys:
where both segments of the pair differ, the third differs in two bits or fewer, so shares one; where one of them doesn't differ, the
keys of a whole segment meet. Keys still that large are cut into blocks, compared two by two in many tasks; those whose rows are all
linked already are left out.

Equal fingerprints are one class before anything is joined. Fingerprints that share both nearest codewords with a common
one are linked to it first; the join then only returns links between what is not yet linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, salted_join, written

SEGMENTS = ((0, 21), (21, 21), (42, 22))
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0xAE3  # of the binary Golay code of length 23
LIMIT = 4
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """A text's fingerprint, unsigned; each shingle votes as often as it occurs. Memory: 8 bytes a word beside the text."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six blanks only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    votes = np.zeros((8, 8), np.int64)
    for i in range(0, len(starts), 1 << 18):
        some = map(whole.__getitem__, map(slice, starts[i : i + (1 << 18)], ends[i : i + (1 << 18)]))
        h = np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(seed)), np.uint64)
        at = h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
        votes += np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * votes > len(starts)).astype(np.uint8), axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", fp: str = "fp") -> DataFrame:
    """docs with the fingerprint (a long of the same 64 bits) of each whole text; null texts are as empty, 0."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(fp, of(F.col(text)))


def _remainder(v: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        v = np.where(v >> bit & 1, v ^ (GENERATOR << (bit - 11)), v)
    return v


def _errors() -> np.ndarray:
    """The error pattern of each remainder: the code is perfect, every remainder has one of three bits or fewer."""
    one = 1 << np.arange(23)
    all_ = np.unique(np.concatenate([[0], (one[:, None, None] | one[:, None] | one).ravel()]))
    out = np.zeros(2048, np.int64)
    out[_remainder(all_)] = all_
    return out


ERRORS = _errors()


def nearest(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit value."""
    return (v ^ ERRORS[_remainder(v)]) >> 11


def ball(fps: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A segment's bits, the indices nearest to them and to their one-bit neighbours, sorted, and which of these are new in their row."""
    at, width = SEGMENTS[segment]
    v = (fps >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1)
    near = np.sort(nearest(np.concatenate([v[:, None], v[:, None] ^ (1 << np.arange(width))], axis=1)), axis=1)
    return v, near, np.concatenate([np.ones((len(v), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)


def keys(fps: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """of: what a fingerprint is stored by; ask: what it is looked up by; both: used on either side. (row, key) each."""
    rows = np.arange(len(fps))
    raw, *balls = zip(*(ball(fps, s) for s in range(len(SEGMENTS))))
    balls, own = [*zip(*balls)], [*map(nearest, raw)]
    of, ask, both = [], [], []
    for p, (a, b) in enumerate(PAIRS):
        of.append((rows, p << 24 | own[a] << 12 | own[b]))
        (na, ua), (nb, ub) = balls[a], balls[b]
        ra, ca = np.nonzero(ua)
        # each key of a with each key of b of the same row
        count = ub.sum(1)
        left = np.repeat(np.arange(len(ra)), count[ra])
        offset = np.arange(len(left)) - np.repeat(np.cumsum(count[ra]) - count[ra], count[ra])
        rb, cb = np.nonzero(ub)
        right = (np.cumsum(count) - count)[ra[left]] + offset
        ask.append((ra[left], p << 24 | na[ra[left], ca[left]] << 12 | nb[rb[right], cb[right]]))
        for q, (x, y) in enumerate(((a, b), (b, a))):
            n, u = balls[y]
            r, c = np.nonzero(u)
            both.append((r, (3 + 2 * p + q) << 40 | raw[x][r] << 12 | n[r, c]))
    return {k: tuple(map(np.concatenate, zip(*v))) for k, v in (("of", of), ("ask", ask), ("both", both))}


def paired(classes: DataFrame) -> DataFrame:
    """classes (fp, node, n) once for each pair of own codewords."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, k = keys(b.column("fp").to_numpy().view(np.uint64))["of"]
            yield pa.RecordBatch.from_arrays([pa.array(k), *(b.column(c).take(pa.array(r)) for c in ("fp", "node", "n"))], ["key", "fp", "node", "n"])

    return classes.select("fp", "node", "n").mapInArrow(of, "key long, fp long, node long, n long")


def keyed(classes: DataFrame) -> DataFrame:
    """(key, fp, part, own) of classes (fp, part), a row for each key; own: not only looked up by it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 4096):  # some 140 rows each
                b = whole.slice(i, 4096)
                found = keys(b.column("fp").to_numpy().view(np.uint64))
                (r, k), own = found["ask"], found["of"][1].reshape(len(PAIRS), -1)
                yield rows(b, r, k, own[k >> 24, r] == k)
                r, k = found["both"]
                yield rows(b, r, k, np.ones(len(r), bool))

    return classes.select("fp", "part").mapInArrow(of, KEYED)


KEYED = "key long, fp long, part long, own boolean"
WHOLE, WIDE = 3 << 40, 9 << 40  # from where keys of whole segments, and wider keys, begin


def rows(b: pa.RecordBatch, r: np.ndarray, key: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), b.column("fp").take(pa.array(r)), b.column("part").take(pa.array(r)), pa.array(own)], ["key", "fp", "part", "own"])


def widened(some: DataFrame) -> DataFrame:
    """Rows of pairs of segments by the third segment's keys too."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, key, own = b.column("fp").to_numpy().view(np.uint64), b.column("key").to_numpy(), b.column("own").to_numpy(zero_copy_only=False)
            for p, pair in enumerate(PAIRS):
                at = np.flatnonzero(key >> 24 == p)
                near, new = ball(fps[at], *({*range(3)} - {*pair}))[1:]
                r, c = np.nonzero(new)
                yield rows(b, at[r], WIDE + (p << 40) + ((key[at[r]] & 0xFFFFFF) << 12) + near[r, c], own[at[r]])

    return some.select("key", "fp", "part", "own").mapInArrow(of, KEYED)


def large(some: DataFrame, block: int) -> DataFrame:
    """(key, g): keys of more than block rows, and how many blocks they make; none if there is nothing to link."""
    counts = some.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
    return written(counts.filter(F.col("n") > block).select("key", F.when(F.col("low") < F.col("high"), F.ceil(F.col("n") / block)).otherwise(0).cast("int").alias("g")))


def dealt(classes: DataFrame, block: int) -> DataFrame:
    """Rows (key, bi, bj, fp, part, own) of classes (fp, part): those of equal key, bi and bj are to be compared."""
    some = keyed(classes)
    many = large(some, block)
    out = some.withColumn("g", F.lit(1))
    if not many.isEmpty():
        some = salted_join(some, many, ["key"], "left").filter("g is null or g > 0")
        again = F.col("g").isNotNull() & (F.col("key") < WHOLE)
        wide = widened(some.filter(again))
        wide = salted_join(wide, large(wide, block), ["key"], "left").filter("g is null or g > 0")
        out = some.filter(~again).select(*wide.columns).unionByName(wide).withColumn("g", F.coalesce("g", F.lit(1)))
    here = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    other = F.explode(F.when(F.col("g") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("g") - 1), lambda j: j != F.col("here"))))
    out = out.withColumn("here", here).withColumn("other", other)
    return out.select("key", F.least("here", "other").alias("bi"), F.greatest("here", "other").alias("bj"), "fp", "part", "own")


def forest(group: np.ndarray, fp: np.ndarray, part: np.ndarray, own: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts to unite: pairs of rows of one group within limit bits, of which one is own. Rows of a group lie together, own ones first."""
    names, at = np.unique(part, return_inverse=True)
    root, left, step = np.arange(len(names)), np.flatnonzero(own), 1
    while True:
        left = left[left + step < len(group)]
        left = left[group[left] == group[left + step]]
        if not len(left):
            break
        x, y = root[at[left]], root[at[left + step]]
        differ = np.flatnonzero(x != y)
        some = left[differ]
        hit = differ[np.bitwise_count(fp[some] ^ fp[some + step]) <= limit]
        x, y = x[hit], y[hit]
        while len(x):
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
            x, y = root[x], root[y]
            differ = x != y
            x, y = x[differ], y[differ]
        step += 1
    joined = np.flatnonzero(root != np.arange(len(root)))
    return names[joined], names[root[joined]]


def united(some: DataFrame, limit: int) -> DataFrame:
    """Rows of dealt() -> (a, b), parts that links unite; at most a row for each part in a batch."""
    n = int(some.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["key", "bi", "bj"]

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Of whole groups."""
        cols = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts]) for c in (*group, "fp", "part", "own")]
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:3]:
            new[1:] |= c[1:] != c[:-1]
        a, b = forest(np.cumsum(new), cols[3].view(np.uint64), cols[4], cols[5], limit)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            new = np.zeros(len(b), bool)
            for c in group:
                v = b.column(c).to_numpy()
                new[1:] |= v[1:] != v[:-1]
                new[0] |= bool(held) and held[-1].column(c)[-1].as_py() != v[0]
            cuts = np.flatnonzero(new)
            if len(cuts):  # all groups before the last are whole
                before = [*held, b.slice(0, cuts[-1])]
                if sum(map(len, before)):
                    yield done(before)
                held = []
            held.append(b.slice(cuts[-1] if len(cuts) else 0))
        if held:
            yield done(held)

    return some.repartition(n, *group).sortWithinPartitions(*group, F.desc("own")).mapInArrow(of, "a long, b long")


def linked(fps: DataFrame, limit: int = LIMIT, block: int = 4096) -> DataFrame:
    """fps (doc_id, fp) -> (fp, component_id), the smallest doc_id reachable by links of at most limit (4 or fewer) bits.

    Fingerprints that only rows without doc_id have aren't linked and are left out. block: rows of a key compared in one task
    at most, or a little more; it changes no result."""
    if not 0 <= limit <= LIMIT:
        raise ValueError(f"limit is 0 to {LIMIT}")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= limit
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("doc_id").alias("n")).filter("n > 0")
    classes = written(classes)
    # the commonest fingerprint of each pair of codewords takes those near it
    stored = paired(classes)
    heads = stored.groupBy("key").agg(F.max_by(F.struct("fp", "node"), F.struct("n", "fp")).alias("h"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    heads = heads.select("key", F.col("h.fp").alias("hfp"), F.col("h.node").alias("hnode"))
    first = stored.join(heads, "key").filter(near("fp", "hfp") & (F.col("node") != F.col("hnode"))).select(F.col("node").alias("a"), F.col("hnode").alias("b"))
    parts = components(first)
    classes = classes.join(parts.withColumnRenamed("component", "part"), "node", "left").select("fp", F.coalesce("part", "node").alias("part"))
    classes = written(classes)
    # then all links between parts
    whole = components(united(dealt(classes, block), limit))
    out = classes.join(whole.withColumnRenamed("node", "part"), "part", "left")
    return out.select("fp", F.coalesce("component", "part").alias("component_id"))


def components_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs. A row without doc_id has the component of its fingerprint, if any."""
    fps = written(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"))
    return fps.join(linked(fps), "fp", "left").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of smallest doc_id of each component. Rows of equal doc_id are one document, of which one row stays (that
    of least text hash); rows without doc_id are not compared and stay."""
    kept = components_of(docs, doc_id, text).filter("doc_id = component_id").select(F.col("doc_id").alias("_heddle_kept")).distinct()
    first = Window.partitionBy(doc_id).orderBy(F.xxhash64(text))
    own = docs.filter(F.col(doc_id).isNotNull()).withColumn("_heddle_row", F.row_number().over(first)).filter("_heddle_row = 1").drop("_heddle_row")
    own = own.join(kept, F.col(doc_id).cast("long") == F.col("_heddle_kept"), "left_semi")
    return own.unionByName(docs.filter(F.col(doc_id).isNull()))
