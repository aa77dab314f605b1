"""Who owns how many lines: counts by author and file, ranks, shares and titles. Authors are canonical, blame is repointed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import numbered


def line_counts(blame: DataFrame) -> DataFrame:
    """(id, total_lines, total_files), from one pass over (author, file) counts."""
    each = blame.groupBy("author_id", "file_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(F.col("author_id").alias("id")).agg(F.sum("n").alias("total_lines"), F.count("file_id").alias("total_files"))


def file_bitmaps(blame: DataFrame) -> DataFrame:
    """(author_id, bucket, files, lines): an author's files as exact bitmaps of 32,768 file numbers each. file_id must be dense, as
    numbers counted from 1 are; a bitmap holds any number of files of its bucket in 4 KB, mostly zeros that compress away."""
    bucket, bit = F.bitmap_bucket_number("file_id").alias("bucket"), F.bitmap_bit_position("file_id")
    return blame.groupBy("author_id", bucket).agg(F.bitmap_construct_agg(bit).alias("files"), F.count(F.lit(1)).alias("lines"))


def merged_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """The bitmaps of days, or of parts of a tree, as those of all: a file that several have counts once, lines add up."""
    return bitmaps.groupBy("author_id", "bucket").agg(F.bitmap_or_agg("files").alias("files"), F.sum("lines").alias("lines"))


def counts_of_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """line_counts() of merged bitmaps."""
    return bitmaps.groupBy(F.col("author_id").alias("id")).agg(F.sum("lines").alias("total_lines"), F.sum(F.bitmap_count("files")).alias("total_files"))


def contributions(authors: DataFrame, blame: DataFrame) -> DataFrame:
    """Canonical authors with lines: total_lines, total_files, percentage, rank by lines (ties by id) and title."""
    out = authors.filter("is_canonical").select("id", "name", "email", "display_name").join(line_counts(blame), "id")
    out = numbered(out, [F.desc("total_lines"), "id"], "rank").withColumn("rank", F.col("rank").cast("int"))
    out = out.crossJoin(F.broadcast(out.agg(F.sum("total_lines").alias("_all"), F.count(F.lit(1)).alias("_n"))))  # one row
    out = out.withColumn("percentage", S.author_percentage(F.col("total_lines"), F.col("_all")))
    return out.withColumn("title", S.title_at(S.distributed_index(F.col("rank") - 1, F.col("_n")))).drop("_all", "_n")


def ranked_authors(authors: DataFrame, blame: DataFrame) -> DataFrame:
    """All authors with rank, percentage and title; those without lines, and merged ones, have null, 0 and null."""
    got = contributions(authors, blame).select("id", "rank", "percentage", "title")
    return authors.join(got, "id", "left").withColumn("percentage", F.coalesce("percentage", F.lit(0.0)))


def inactive(authors: DataFrame, blame: DataFrame) -> DataFrame:
    """Canonical authors without lines."""
    return authors.filter("is_canonical").join(blame.select(F.col("author_id").alias("id")).distinct(), "id", "left_anti")


def file_contributions(files: DataFrame, blame: DataFrame) -> DataFrame:
    """(author_id, filename, path, author_lines, total_lines, percentage) of each author and file with lines of theirs."""
    each = blame.groupBy("author_id", "file_id").agg(F.count(F.lit(1)).alias("author_lines"))
    out = each.join(files.select("file_id", "path", "total_lines"), "file_id")
    return out.select("author_id", S.file_name(F.col("path")).alias("filename"), "path", "author_lines", "total_lines", S.file_percentage(F.col("author_lines"), F.col("total_lines")).alias("percentage"))


def top_files(files: DataFrame, blame: DataFrame, n: int = 5) -> DataFrame:
    """The n files of most lines of each author, ties by path, with their place."""
    place = F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc("author_lines"), "path"))
    return file_contributions(files, blame).withColumn("place", place).filter(F.col("place") <= n)


def extended_report(authors: DataFrame, files: DataFrame, blame: DataFrame, n: int = 5) -> DataFrame:
    """contributions() with top_files, an array in order."""
    best = top_files(files, blame, n).groupBy(F.col("author_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "filename", "path", "author_lines", "total_lines", "percentage"))).alias("top_files"))
    return contributions(authors, blame).join(best, "id", "left").orderBy("rank")


def developer_report(authors: DataFrame, files: DataFrame, blame: DataFrame, email: str, n: int = 15) -> DataFrame:
    """The n files of most lines of the author whom an e-mail, their own or an alias's, belongs to."""
    from .identity import find_canonical

    one = find_canonical(authors, authors.filter(F.col("email") == F.lit(email)).select("email"))
    own = blame.join(one.select(F.col("canonical_id").alias("author_id")), "author_id", "left_semi")
    return file_contributions(files, own).orderBy(F.desc("author_lines"), "path").limit(n)


def pie(contributed: DataFrame, n: int = 10) -> DataFrame:
    """The first n contributors with their segments' widths, and how many others there are."""
    others = contributed.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("others"))  # one row
    out = contributed.filter(F.col("rank") <= n).crossJoin(F.broadcast(others))
    return out.select("rank", "display_name", "percentage", S.half_up(F.col("percentage")).cast("long").alias("rounded"), S.segment_width(F.col("percentage")).alias("width"), "others")


def first_and_last(contributed: DataFrame) -> DataFrame:
    """The contributor of most lines, and of least if there is another."""
    last = contributed.agg(F.max("rank").alias("_last"))  # one row
    out = contributed.crossJoin(F.broadcast(last)).filter((F.col("rank") == 1) | (F.col("rank") == F.col("_last")))
    place = F.when(F.col("rank") == 1, "first").otherwise("last")
    return out.select(place.alias("place"), S.short_name(F.col("display_name")).alias("name"), S.capitalized(F.col("title")).alias("title"), S.half_up(F.col("percentage")).cast("long").alias("percentage"))


def nth(contributed: DataFrame, n: int) -> DataFrame:
    """The contributor at place n, counted from 1; no row beyond the last."""
    return contributed.filter(F.col("rank") == n)


def developers(authors: DataFrame, blame: DataFrame) -> DataFrame:
    """One row: how many authors have lines (n_developers), and how many there are before any merge (n_authors)."""
    own = authors.filter("is_canonical").join(blame.select(F.col("author_id").alias("id")).distinct(), "id", "left_semi")
    return own.agg(F.count(F.lit(1)).alias("n_developers")).crossJoin(F.broadcast(authors.agg(F.count(F.lit(1)).alias("n_authors"))))  # a row each
