"""The parquet test tables as tracked files, lines and authors, so that every query runs on them as on attribution data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, identity
from ..storage import dealt

ENDINGS = {0: ".png", 1: ".test.ts", 2: ".snap", 3: ".PDF", 4: ".lock", 5: ".py", 6: ".min.js"}


@dataclass
class Tables:
    """files (file_id, path, size, flags, total_lines), authors (id, .., canonical_id, is_canonical), blame (author_id, file_id, ..)."""

    files: DataFrame
    authors: DataFrame
    blame: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as tracked files."""
    key = F.col("o_orderkey")
    ending = F.lit(".ts")
    for k, v in ENDINGS.items():
        ending = F.when(key % 12 == k, v).otherwise(ending)
    path = F.concat(F.lit("src/"), F.replace(F.lower("o_orderpriority"), F.lit(" "), F.lit("")), F.lit("/f"), key.cast("string"), ending)
    return table(spark, sf_dir, "orders").select(key.alias("file_id"), path.alias("path"), F.floor(F.col("o_totalprice") / 4).cast("long").alias("size"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and e-mails, by part number modulo 400."""
    email = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("@"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit(".example"))
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 400).alias("person")).agg(F.min("p_name").alias("name"), F.min(email).alias("email"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as lines, with the person who wrote each."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_partkey") % 400).alias("person"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("commit_ts"))


def lines_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines, a file's in one task; what follows joins and groups them there."""
    every = lines(spark, sf_dir)
    return dealt(every, every.count(), "file_id")


def load(spark: SparkSession, sf_dir: str, policy: str = "strict") -> Tables:
    """Lines of analyzed files only; authors by e-mail in order of their first line, merged by the policy."""
    known = identity.stored(classify.classify(files(spark, sf_dir)))  # read by both what follows and the lines' filter
    named = lines_by_file(spark, sf_dir).join(classify.analyzed(known).select("file_id"), "file_id", "left_semi").join(F.broadcast(people(spark, sf_dir)), "person")  # 400 rows
    authors = identity.stored(identity.normalize(identity.upsert(named.select("email", "name", F.struct("file_id", "line", "person").alias("ord"))), policy))
    blame = identity.attributed(named, authors).select("author_id", "file_id", "commit_ts")
    return Tables(classify.with_total_lines(known, blame), authors, blame)
