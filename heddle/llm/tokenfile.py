"""Token ids in files: static range asymmetric numeral coding with shared frequencies (operator 2).

A folder holds `model` (symbol, n, the corpus counts that every block's frequencies come from) and `blocks`, Parquet rows
that decode alone: shard and block number, the documents' ids and lengths, a crc32 of the block's ids, the 32-bit words of
LANES interleaved coders, and checkpoints (row, word, coder states, crc32 of the ids up to the next) from which several readers
start inside a block: read() decodes blocks of more than PIECE checkpoints, those of very long documents, in pieces of so many,
each by a task of its own that gets its words alone, and joins the documents' checksums from those of their parts. Shards are ranges of doc_id; within one, documents ascend by doc_id. Whole documents are never cut between blocks.

An empty table gives no rows; other columns are not read, whatever their names. Null and empty texts are documents of the end id alone; null doc_ids come first; rows of equal doc_id are ordered by their ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .words import binaries

LANES, BLOCK, CHECK, BITS, PIECE = 2048, 1 << 19, 64, 20, 8
#: States are at least LOW and below LOW << 32, so that they are exact as doubles, and so are floors of quotients.
LOW, TOP_BITS = 1 << BITS, BITS + 32


class Model:
    """Counts scaled to 2**BITS; both sides make the same table from the same counts."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols, counts = symbols[order].astype(np.uint32), counts[order].astype(np.float64)
        self.bits = BITS
        if len(counts) > 1 << (BITS - 2):
            raise ValueError(f"more than {1 << (BITS - 2)} symbols do not fit frequencies of {BITS} bits")
        f = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * (1 << self.bits))).astype(np.int64)
        more = (1 << self.bits) - int(f.sum())
        for i in np.argsort(-f, kind="stable"):  # frequent symbols give or take what rounding left
            if not more:
                break
            step = more if more > 0 else max(more, 1 - int(f[i]))
            f[i] += step
            more -= step
        self.f, self.c = f, np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.int64)
        self.slots = np.repeat(np.arange(len(f), dtype=np.uint32), f)
        self.index = np.zeros(int(self.symbols.max(initial=0)) + 1, np.int64)
        self.index[self.symbols] = np.arange(len(f))

    def encode(self, ids: np.ndarray) -> tuple[bytes, list[int], list[int], bytes]:
        """words, then the row, the word and the states (64 bit, one a lane) of each checkpoint."""
        at, n, bits, top = self.index[ids], len(ids), self.bits, TOP_BITS - self.bits
        x = np.full(LANES, LOW, np.int64)
        out: list[np.ndarray] = []
        marks: list[tuple[int, int, bytes]] = []
        emitted = 0
        for row in reversed(range(-(-n // LANES))):
            s = at[row * LANES : (row + 1) * LANES]
            v, f = x[: len(s)], self.f[s]
            over = v >= (f << top)
            if over.any():
                out.append((v[over] & 0xFFFFFFFF).astype("<u4"))
                emitted += len(out[-1])
                v = np.where(over, v >> 32, v)
            q = (v / f).astype(np.int64)
            x[: len(s)] = (q << bits) + (v - q * f) + self.c[s]
            if row % CHECK == 0:
                marks.append((row, emitted, x.astype("<i8").tobytes()))
        marks.reverse()
        words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
        return words.tobytes(), [m[0] for m in marks], [emitted - m[1] for m in marks], b"".join(m[2] for m in marks)

    def decode(self, n: int, words: bytes, rows: list[int], starts: list[int], states: bytes, first: int = 0, last: int | None = None, ends: bool = True) -> np.ndarray:
        """The ids of a block of n, or of its checkpoints first to last alone. ends: n is the block's end."""
        end = -(-n // LANES) if last is None or last >= len(rows) else rows[last]
        w, x = np.frombuffer(words, "<u4").astype(np.int64), np.frombuffer(states, "<i8").reshape(-1, LANES)[first].copy()
        pos, bits, mask = starts[first], self.bits, (1 << self.bits) - 1
        begin = rows[first]
        out = np.empty(min(n, end * LANES) - begin * LANES, np.uint32)
        for row in range(begin, end):
            to = out[(row - begin) * LANES : (row - begin + 1) * LANES]
            v = x[: len(to)]
            slot = v & mask
            s = self.slots[slot]
            to[:] = s
            v = self.f[s] * (v >> bits) + slot - self.c[s]
            need = np.flatnonzero(v < LOW)
            v[need] = (v[need] << 32) | w[pos : pos + len(need)]
            pos += len(need)
            x[: len(to)] = v
        if end * LANES >= n and (pos != len(w) or ends and (x != LOW).any()):
            raise ValueError("a block's coders do not end where they began")
        return self.symbols[out]


def id_type(tokenizer: str, end_id: int) -> str:
    """16 bits where all ids fit, else 32."""
    from tokenizers import Tokenizer

    most = max([end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()])
    return "<u2" if most < 1 << 16 else "<u4"


def ended(texts: pa.Array, tokenizer: str, end_id: int, kind: str) -> pa.BinaryArray:
    """The ids of each text, end_id last, as bytes of numbers of that kind."""
    from .tokens import memory

    lists = memory(tokenizer).of_texts(texts)
    ends = lists.offsets.to_numpy().astype(np.int64) + np.arange(len(texts) + 1)
    ids = np.full(ends[-1], end_id, kind)
    inside = np.ones(len(ids), bool)
    inside[ends[1:] - 1] = False
    ids[inside] = lists.values.to_numpy()
    return binaries(ends * ids.itemsize, ids.view(np.uint8)).cast(pa.binary())


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ids: numbers of that kind with end_id last)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), ended(b.column(1), tokenizer, end_id, kind)], ["doc_id", "ids"])

    return docs.mapInArrow(of, "doc_id long, ids binary")


def counts(tokens: DataFrame, kind: str) -> DataFrame:
    """(symbol, n) over every id of all documents; one row a symbol and task is shuffled."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            got = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=len(total))
            if len(got) > len(total):
                total = np.pad(total, (0, len(got) - len(total)))
            total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["symbol", "n"])

    return tokens.select("ids").mapInArrow(of, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def fitted(spark: SparkSession, path: str) -> Model:
    """From the counts in path; they have a row a vocabulary entry at most."""
    rows = spark.read.parquet(f"{path}/model").toPandas()
    return Model(rows["symbol"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


BLOCKS = "shard int, block int, n_ids long, crc32 long, doc_ids array<long>, lengths array<int>, check_rows array<int>, check_words array<int>, check_crcs array<long>, states binary, words binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Tokenizes each whole text once, appends end_id, and writes the folder path: first the counts, then the blocks."""
    spark = docs.sparkSession
    kind = id_type(tokenizer, end_id)
    size = int(kind[-1])
    tokens = written(tokenized(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), tokenizer, end_id, kind))
    counts(tokens, kind).coalesce(1).write.parquet(f"{path}/model")
    shared = spark.sparkContext.broadcast(fitted(spark, path))  # bounded by the vocabulary

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shard, number = shared.value, TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        owners: list[int | None] = []
        held = 0

        def block() -> pa.RecordBatch:
            all_ids = np.frombuffer(b"".join(ids), kind).astype("<u4")
            words, rows, starts, states = model.encode(all_ids)
            crcs = [zlib.crc32(all_ids[r * LANES : (r + CHECK) * LANES].tobytes()) for r in rows]
            values = [shard, number, len(all_ids), zlib.crc32(all_ids.tobytes()), owners, [len(i) // size for i in ids], rows, starts, crcs, states, words]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

        for b in batches:
            for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(raw)
                owners.append(d)
                held += len(raw) // size
                if held >= BLOCK:
                    yield block()
                    number, ids, owners, held = number + 1, [], [], 0
        if ids:
            yield block()

    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(of, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of byte strings one after another, from the crc32 and the length of each.

    A checksum is a polynomial over two elements, bit 31 its constant; what follows multiplies it by x to the bits that follow."""

    def times(a: int, b: int) -> int:
        out = 0
        while a:
            if a & 0x80000000:
                out ^= b
            a = a << 1 & 0xFFFFFFFF
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    whole = 0
    for crc, n in parts:
        power, square, left = 0x80000000, 0x40000000, 8 * n  # 1, x
        while left:
            if left & 1:
                power = times(square, power)
            square, left = times(square, square), left >> 1
        whole = times(power, whole) ^ crc
    return whole


def pieces(blocks: DataFrame) -> DataFrame:
    """Of large blocks, a row for every PIECE checkpoints with the words and the states that these need."""
    rows = blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("check_rows") - 1, F.lit(PIECE))))
    at = lambda c, other: F.coalesce(F.get(c, F.col("k") + PIECE), other)
    begin, end = F.get("check_words", F.col("k")), at("check_words", (F.length("words") / 4).cast("int"))
    low, high = F.get("check_rows", F.col("k")).cast("long") * LANES, F.coalesce(F.get("check_rows", F.col("k") + PIECE).cast("long") * LANES, F.col("n_ids"))
    rows = rows.select("shard", "block", "n_ids", "doc_ids", "lengths", low.alias("low"), high.alias("high"), F.slice("check_crcs", F.col("k") + 1, PIECE).alias("check_crcs"), F.substring("states", F.col("k") * (8 * LANES) + 1, F.lit(8 * LANES)).alias("states"), F.substring("words", begin * 4 + 1, (end - begin) * 4).alias("words"))
    return rows.repartition("shard", "block", "low")


def parts_of(rows: DataFrame, shared, ids: bool) -> DataFrame:
    """pieces() decoded -> documents (shard, block, doc_id, at, n_tokens, ids_crc32, ids), whose parts are put together."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                b = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                low, high = b["low"], b["high"]
                got = shared.value.decode(high - low, b["words"], [0], [0], b["states"], ends=high == b["n_ids"]).astype("<u4")
                step = CHECK * LANES
                if [zlib.crc32(got[j : j + step].tobytes()) for j in range(0, len(got), step)] != b["check_crcs"]:
                    raise ValueError(f"checksum of shard {b['shard']}, block {b['block']}, ids from {low}")
                ends = np.cumsum(np.array(b["lengths"], np.int64))
                begins = ends - b["lengths"]
                here = np.flatnonzero((begins < high) & (ends > low))
                cuts = [got[max(begins[j], low) - low : min(ends[j], high) - low] for j in here]
                cols = [pa.array([b[k]] * len(here), pa.int32()) for k in ("shard", "block")]
                cols += [pa.array(here), pa.array([b["doc_ids"][j] for j in here], pa.int64()), pa.array(begins[here]), pa.array((ends - begins)[here]), pa.array([low] * len(here), pa.int64()), pa.array([len(c) for c in cuts], pa.int64()), pa.array([zlib.crc32(c.tobytes()) for c in cuts], pa.int64())]
                if ids:
                    cols.append(pa.array([c.astype(np.int32) for c in cuts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, fields)

    @F.arrow_udf("long")
    def joined(lengths: pa.Array, crcs: pa.Array) -> pa.Array:
        return pa.array([joined_crc([(c, 4 * n) for n, c in zip(*x)]) for x in zip(lengths.to_pylist(), crcs.to_pylist())], pa.int64())

    kinds = "shard int, block int, j long, doc_id long, at long, n_tokens long, low long, n long, crc long" + ", ids array<int>" * ids
    fields = [c.split()[0] for c in kinds.split(", ")]
    part = F.struct("low", "n", "crc", *["ids"] * ids)
    whole = rows.mapInArrow(of, kinds).groupBy("shard", "block", "j").agg(*(F.first(c).alias(c) for c in ("doc_id", "at", "n_tokens")), F.array_sort(F.collect_list(part)).alias("parts"))  # as many as the document is long
    out = whole.select("shard", "block", "doc_id", "at", "n_tokens", joined(F.col("parts.n"), F.col("parts.crc")).alias("ids_crc32"), *[F.flatten("parts.ids").alias("ids")] * ids)
    return out


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of each document in path.

    Every block, or every checkpoint's part of a large one, is decoded and held against its checksum; starts come from headers."""
    shared = spark.sparkContext.broadcast(fitted(spark, path))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i in range(len(batch)):
                b = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                got = model.decode(b["n_ids"], b["words"], b["check_rows"], b["check_words"], b["states"])
                raw = got.astype("<u4").tobytes()
                if zlib.crc32(raw) != b["crc32"]:
                    raise ValueError(f"checksum of shard {b['shard']}, block {b['block']}")
                n = np.array(b["lengths"], np.int64)
                ends = np.cumsum(n)
                crcs = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                cols = [pa.array([b[k]] * len(n), pa.int32()) for k in ("shard", "block")]
                cols += [pa.array(b["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crcs, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(got.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, fields)

    kinds = "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    fields = [c.split()[0] for c in kinds.split(", ")]
    heads = blocks.select("shard", "block", "n_ids")
    first = heads.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row a shard
    first = first.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    heads = heads.join(first, "shard").select("shard", "block", (F.col("before") + F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("before"))
    large = F.col("n_ids") > PIECE * CHECK * LANES  # so many checkpoints; Parquet's statistics tell where there is none
    out = blocks.filter(~large).mapInArrow(of, kinds).unionByName(parts_of(pieces(blocks.filter(large)), shared, ids)).join(heads, ["shard", "block"])
    return out.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
