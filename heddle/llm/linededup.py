"""Line dedup over levelled sorted runs of line hashes (operator 8); DataFrame functions only.

A run is a table (h1, h2, docs, last) sorted by hash: how many documents hold a line, and the largest doc_id among them.
Each batch of documents is merge-joined with the runs there are, and what they don't settle is written as a new run of level 0;
FANOUT runs of a level are compacted into one of the next. Lines are then held against all runs together. Runs outlive the
session: Runs(spark, folder) opens them again, and further batches may be added.

A line's key is the line without blanks at both ends, A-Z lower-cased, known by 128 bits of hash. Keys of at least
min_chars code points in at least min_docs documents lose all lines but those of the largest doc_id. Null and empty texts
are one empty line, an empty table gives no rows, very long texts are read whole. Rows of equal doc_id count as one document. Rows without doc_id don't count and lose no lines.
Other columns stay, whatever their names, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, lower_ascii, scratch, written

FANOUT = 4
H = ["h1", "h2"]


def lines_of(c):
    return F.split(F.coalesce(c, F.lit("")), "\n")


def key_of(line):
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def hashed(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, whole, pos, h1, h2) of each line that is long enough; whole is the text's hash, as doc_id may repeat."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("whole"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).filter(F.length("line") >= min_chars)
    lines = lines.select("doc_id", "whole", "pos", key_of(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return lines.select("doc_id", "whole", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


COLUMNS = "h1 BIGINT, h2 BIGINT, docs BIGINT, last BIGINT"


class Runs:
    """The levels below a folder that all executors see; each holds fewer than FANOUT runs.

    A run is a Parquet table of `buckets` hash buckets, each sorted, so that a batch joins it without moving it. What runs there
    are is a manifest, written anew with each change; Runs(spark, folder) goes on from the last one, in any session. One writer
    at a time."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark, self.folder = spark, folder or scratch(spark)
        self.levels: list[list[str]] = []
        self.version, self.buckets = 0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, str] = {}
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            for r in self._last():
                self.version, self.buckets = r.version, r.buckets
                while len(self.levels) <= r.level:
                    self.levels.append([])
                self.levels[r.level].append(r.run)

    def _last(self) -> list:
        every = self.spark.read.parquet(f"{self.folder}/manifest")
        last = every.agg(F.max("version").alias("_last"))
        return every.join(last, every["version"] == last["_last"]).orderBy("level", "run").collect()  # a row a run

    def _noted(self) -> None:
        self.version += 1
        rows = [(self.version, self.buckets, level, run) for level, runs in enumerate(self.levels) for run in runs]
        self.spark.createDataFrame(rows, "version int, buckets int, level int, run string").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def run(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = f"heddle_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.tables[name]} ({COLUMNS}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(self.tables[name])

    def _store(self, run: DataFrame, level: int) -> None:
        name = f"run={uuid.uuid4().hex}"
        self.tables[name] = f"heddle_run_{uuid.uuid4().hex}"
        rows = run.select(*H, "docs", "last").repartition(self.buckets, *H).sortWithinPartitions(*H)
        rows.write.format("parquet").bucketBy(self.buckets, *H).sortBy(*H).option("path", f"{self.folder}/{name}").saveAsTable(self.tables[name])
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= FANOUT:
            full, self.levels[level] = self.levels[level], []
            self._store(merged([self.plain(r) for r in full]), level + 1)

    def plain(self, name: str) -> DataFrame:
        """Without its buckets, as Spark takes a union of bucketed tables for one that needs no shuffle, which isn't so."""
        return self.spark.read.schema(COLUMNS).parquet(f"{self.folder}/{name}")

    def all(self) -> list[DataFrame]:
        return [self.plain(r) for level in self.levels for r in level]

    def unsettled(self, batch: DataFrame, min_docs: int) -> DataFrame:
        """batch (h1, h2, docs, last) without what the runs already settle: min_docs documents, and a last one beyond the batch's.

        The runs stay where they are; only the batch is shuffled."""
        docs, last = F.lit(0), F.lit(None).cast("long")
        for k, name in enumerate(r for level in self.levels for r in level):
            own = self.run(name).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("docs").alias(f"docs{k}"), F.col("last").alias(f"last{k}"))
            batch = batch.join(own.hint("merge"), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left").drop("_h1", "_h2")
            docs, last = docs + F.coalesce(f"docs{k}", F.lit(0)), F.greatest(last, F.col(f"last{k}"))
        return batch.filter(~((docs >= min_docs) & F.coalesce(last > F.col("last"), F.lit(False)))).select(*H, "docs", "last")

    def add(self, lines: DataFrame, min_docs: int = 3) -> None:
        """lines (doc_id, h1, h2) of a batch of new documents, none of them in an earlier batch."""
        per_doc = lines.filter("doc_id is not null").select(*H, "doc_id").distinct()
        batch = per_doc.groupBy(*H).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
        self._store(self.unsettled(batch, min_docs), 0)
        self._noted()

    def close(self) -> None:
        """Forgets the catalog's names; the files stay."""
        for t in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.tables.clear()


def merged(runs: list[DataFrame]) -> DataFrame:
    """The runs as one."""
    return reduce(DataFrame.unionByName, runs).groupBy(*H).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))


def dropped_lines(docs: DataFrame, batches: int = 4, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, whole, drops): the positions of the lines that each document loses. Batches are ranges of doc_id, largest first."""
    lines = written(hashed(docs, min_chars))
    cuts = lines.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    edges = [None, *sorted(set(cuts or [])), None]
    runs = Runs(docs.sparkSession)
    for low, high in reversed([*zip(edges, edges[1:])]):
        part = lines if low is None else lines.filter(F.col("doc_id") > low)
        runs.add(part if high is None else part.filter(F.col("doc_id") <= high), min_docs)
    common = written(merged(runs.all()).filter(F.col("docs") >= min_docs))
    runs.close()
    found = lines.join(common, H).filter(F.col("doc_id") != F.col("last"))
    return found.groupBy("doc_id", "whole").agg(F.collect_set("pos").alias("drops"))  # as many as the document has lines


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **rules) -> DataFrame:
    """docs with text without its dropped lines, n_lines (before) and n_dropped. Columns of those names are replaced."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    drops = dropped_lines(own, **rules).select(F.col("doc_id").alias("_heddle_of"), F.col("whole").alias("_heddle_whole"), F.col("drops").alias("_heddle_drops"))
    out = docs.drop("n_lines", "n_dropped").join(drops, (F.col(doc_id) == F.col("_heddle_of")) & (F.xxhash64(text) == F.col("_heddle_whole")), "left")
    out = out.withColumn("_heddle_lines", lines_of(F.col(text)))
    out = out.withColumn("n_lines", F.size("_heddle_lines").cast("long")).withColumn("n_dropped", F.coalesce(F.size("_heddle_drops"), F.lit(0)).cast("long"))
    rest = F.array_except(F.sequence(F.lit(0), F.size("_heddle_lines") - 1), F.col("_heddle_drops"))
    kept = F.concat_ws("\n", F.transform(rest, lambda i: F.get("_heddle_lines", i)))
    out = out.withColumn(text, F.when(F.col("_heddle_drops").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(kept))
    return out.drop("_heddle_of", "_heddle_whole", "_heddle_drops", "_heddle_lines")


ORACLE = r"""
WITH l AS (
  SELECT d.doc_id, u.i, u.line, translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                                    generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS i) u),
c AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.last AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
