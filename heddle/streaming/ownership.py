"""Line ownership over a folder in which blame outputs keep arriving; each file's newest output counts.

maintain() keeps the newest outputs and hands all of them on; totals() keeps each file's counts as keyed state instead, and adds
up what each batch changes, so that a batch of few files is little work however many there are."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import porcelain


def drops(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Streaming (path, porcelain, modified) of text files; a name's part before a # is the path, / written as %2F."""
    read = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True)
    name = F.regexp_extract(F.url_decode("_metadata.file_name"), "^[^#]*", 0)
    return read.load(folder).select(F.url_decode(name).alias("path"), F.col("value").alias("porcelain"), F.col("_metadata.file_modification_time").alias("modified"))


#: Batches between two compactions.
EACH = 16


def newest(held: DataFrame) -> DataFrame:
    """Of each path, the row written last; texts stay where they are until the choice, of names and times alone, is made."""
    place = F.struct("modified", "batch")
    heads = held.groupBy("path").agg(F.max(place).alias("_last"))
    heads = heads.select(F.col("path").alias("_path"), F.col("_last.modified").alias("_modified"), F.col("_last.batch").alias("_batch"))
    same = (F.col("path") == F.col("_path")) & F.col("modified").eqNullSafe(F.col("_modified")) & (F.col("batch") == F.col("_batch"))
    return held.join(heads, same, "left_semi").dropDuplicates(["path"])


def kept(stream: DataFrame, store: str, checkpoint: str, fold: Callable[[DataFrame], DataFrame], then: Callable[[DataFrame], None], each: int = EACH) -> StreamingQuery:
    """Writes each batch to the Parquet folder store/from=A/batch=N, and calls then() with the fold of all rows so far.

    Every `each` batches the fold becomes the first of a new folder from=N, from which later batches go on; so a batch reads the
    fold and `each` batches at most. fold() gives rows of the batches' columns, but for batch, that can be folded again. A folder
    is read only once its first batch is whole, and a batch that runs again after a failure writes the same again. Folders from
    before the last compaction but one go."""

    def held_in(spark: SparkSession, start: int) -> DataFrame:
        batches = spark.read.parquet(f"{store}/from={start}/batches")
        return batches.unionByName(spark.read.parquet(f"{store}/from={start}/whole")) if start else batches

    def run(batch: DataFrame, number: int) -> None:
        spark, start = batch.sparkSession, number // each * each
        folder = f"{store}/from={start}"
        if number == start and start:
            before = held_in(spark, start - each)
            fold(before).withColumn("batch", F.lit(start - 1).cast("int")).write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/whole")
            if start >= 2 * each:
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/from={start - 2 * each}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        batch.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")
        then(fold(held_in(spark, start)))

    return stream.writeStream.foreachBatch(run).outputMode("append" if fold is newest else "update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain(stream: DataFrame, store: str, checkpoint: str, then: Callable[[DataFrame], None], each: int = EACH) -> StreamingQuery:
    """Calls then() with the newest output (path, porcelain) of every path so far."""
    return kept(stream, store, checkpoint, newest, lambda held: then(held.select("path", "porcelain")), each)


def changes(stream: DataFrame) -> DataFrame:
    """Streaming (path, email, lines, files) of outputs (path, porcelain, modified): what each adds to an author's lines and files,
    and, less than 0, takes back of what the file's output before had. An output older than one seen before changes nothing."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, "{}")
        old = json.loads(held)
        new = old
        for frame in frames:
            for modified, emails in zip(frame["modified"], frame["emails"]):
                if last is None or modified >= last:
                    last, new = float(modified), Counter(emails.split("\n")[:-1])
        if last is not None:
            state.update((last, json.dumps(new)))
        changed = [e for e in {**old, **new} if new.get(e, 0) != old.get(e, 0)]
        lines, files = [new.get(e, 0) - old.get(e, 0) for e in changed], [(e in new) - (e in old) for e in changed]
        yield pd.DataFrame({"path": [key[0]] * len(changed), "email": changed, "lines": lines, "files": files})

    time = F.coalesce(F.unix_micros("modified").cast("double"), F.lit(0.0))
    rows = stream.select("path", time.alias("modified"), F.array_join(F.transform(porcelain.emails(F.col("porcelain")), lambda e: F.concat(e, F.lit("\n"))), "").alias("emails"))
    kinds = "path string, email string, lines long, files long", "modified double, counts string"
    return rows.groupBy("path").applyInPandasWithState(step, *kinds, "update", GroupStateTimeout.NoTimeout)


def added_up(changed: DataFrame) -> DataFrame:
    """changes() by author and file, those that came to nothing left out."""
    return changed.groupBy("path", "email").agg(F.sum("lines").alias("lines"), F.sum("files").alias("files")).filter("lines <> 0 or files <> 0")


def by_author(changed: DataFrame) -> DataFrame:
    """(email, total_lines, total_files)"""
    return changed.groupBy("email").agg(F.sum("lines").alias("total_lines"), F.sum("files").alias("total_files")).filter("total_lines > 0")


def totals(stream: DataFrame, store: str, checkpoint: str, then: Callable[[DataFrame], None], each: int = EACH) -> StreamingQuery:
    """Calls then() with the changes so far, added up by author and file: the lines that each author has in each file, which by_author() sums."""
    return kept(changes(stream), store, checkpoint, added_up, then, each)
