"""Which files are analyzed, and counts over files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.constants import THRESHOLD_KB

ANALYZED = "kind = 'analyzed'"


def classify(files: DataFrame, threshold_bytes: float = THRESHOLD_KB * 1024) -> DataFrame:
    """files (path, size, ..) with extension, is_binary, is_ignored, is_larger_than_threshold, tested in that order, and kind,
    the first that holds (binary, ignored, large) or else analyzed.

    The size of files that an earlier test excludes, or that are null (unreadable: binary and ignored at once), is 0."""
    size, kind = F.col("size"), F.col("kind")
    tests = F.when(size.isNull() | S.is_binary(F.col("path")), "binary").when(S.is_ignored(F.col("path")), "ignored").when(size > threshold_bytes, "large")
    out = files.withColumn("kind", tests.otherwise("analyzed"))
    return out.withColumns({
        "extension": S.extension(F.col("path")), "is_binary": kind == "binary", "is_ignored": (kind == "ignored") | size.isNull(), "is_larger_than_threshold": kind == "large",
        "size": F.when(kind.isin("binary", "ignored"), 0).otherwise(size).cast("long"),
    })


def analyzed(files: DataFrame) -> DataFrame:
    return files.filter(ANALYZED)


def with_total_lines(files: DataFrame, blame: DataFrame) -> DataFrame:
    """files with total_lines; files without lines have 0. blame holds non-blank lines only."""
    return files.join(blame.groupBy("file_id").agg(F.count(F.lit(1)).alias("total_lines")), "file_id", "left").withColumn("total_lines", F.coalesce("total_lines", F.lit(0)).cast("long"))


def repository_stats(files: DataFrame, authors: DataFrame) -> DataFrame:
    """One row; total_authors counts all, merged ones too."""
    one = files.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.expr(ANALYZED)).alias("analyzed_files"), F.count_if(F.col("kind") == "binary").alias("binary_files"),
        F.count_if(F.col("kind") == "ignored").alias("ignored_files"), F.count_if(F.col("kind") == "large").alias("large_files"),
        F.coalesce(F.sum(F.when(F.expr(ANALYZED), F.col("total_lines"))), F.lit(0)).cast("long").alias("total_lines"),
    )
    return one.crossJoin(F.broadcast(authors.agg(F.count(F.lit(1)).alias("total_authors"))))  # a row each
