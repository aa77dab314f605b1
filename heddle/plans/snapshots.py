"""Lines that are kept from one analysis to the next: only files that changed are read anew.

A snapshot has an index (path, version, segment) of all files that were read, and segments, Parquet folders of lines. A refresh
compares files (path, version) with the index, reads those that are new or of another version into a segment of its own, and
carries the others over; files that are gone leave the index. Lines are those whose path and segment the index names. When there
are more than `most` segments, what lives is written into one. Versions change as a whole (heddle.versions): a refresh that fails
leaves the snapshot as it was, at the cost of a folder that the next compaction deletes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from ..versions import Versions

INDEX = "path string, version string, segment string"


class Snapshot:
    """read: files (path, ..) -> their lines (path, ..), of one schema always."""

    def __init__(self, spark: SparkSession, folder: str, read: Callable[[DataFrame], DataFrame], most: int = 16):
        self.spark, self.read, self.most, self.versions = spark, read, most, Versions(spark, folder)

    def index(self) -> DataFrame:
        _, now = self.versions.latest()
        return self.spark.read.schema(INDEX).parquet(self.versions.at(now["index"])) if now else self.spark.createDataFrame([], INDEX)

    def state(self) -> dict:
        """What the last refresh was told to keep beside the lines."""
        return self.versions.latest()[1].get("state", {})

    def lines(self) -> DataFrame:
        """Of all files that the index names; other segments' folders are not opened."""
        _, now = self.versions.latest()
        return self._lines(now["segments"], self.index())

    def _lines(self, segments: list[str], index: DataFrame) -> DataFrame:
        read = self.spark.read.parquet(*(self.versions.at(f"lines/{s}") for s in segments))
        own = read.withColumn("segment", F.regexp_extract("_metadata.file_path", "lines/([0-9a-f]{32})/", 1))
        return own.join(index.select("path", "segment"), ["path", "segment"], "left_semi").drop("segment")

    def refresh(self, files: DataFrame, state: dict | None = None) -> int:
        """files (path, version, ..), one row a path; the number of files that were read. A null version is never equal to another."""
        number, now = self.versions.latest()
        files = written(files)
        held = self.index()
        same = files.select("path", "version").join(held, ["path", "version"], "left_semi").select("path")
        fresh = written(files.join(same, "path", "left_anti"))
        segments, n = now.get("segments", []), fresh.count()
        index = held.join(same, "path", "left_semi")
        if n or not segments:
            part = self.versions.new("lines")
            self.read(fresh).write.parquet(self.versions.at(part))
            segment = part.rpartition("/")[2]
            index = index.unionByName(fresh.select("path", "version", F.lit(segment).alias("segment")))
            segments = [*segments, segment]
        if compact := len(segments) > self.most:
            index = written(index)
            part = self.versions.new("lines")
            self._lines(segments, index).write.parquet(self.versions.at(part))
            segments = [part.rpartition("/")[2]]
            index = index.withColumn("segment", F.lit(segments[0]))
        at = self.versions.new("index")
        index.write.parquet(self.versions.at(at))
        self.versions.commit(number, {"index": at, "segments": segments, "state": state or {}})
        if compact:
            self.versions.prune(["index", "lines"])
        return n
