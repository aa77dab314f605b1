"""What several operators share: rules of words, connected components, joins with hot keys. Arrow batches are bounded by Spark's own
spark.sql.execution.arrow.maxBytesPerBatch; no operator changes the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch, written  # noqa: F401

#: White space of the word rule `[^\x20\x09-\x0D]+`.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c):
    """A-Z lower-cased and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words_of(c):
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != F.lit(""))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected edges, component the smallest node reachable.

    Alternates large-star and small-star until nothing changes (O(log² n) rounds); each round is one aggregate and one
    join, written to the shared folder. Self loops and nulls are dropped; nodes without edges don't appear."""
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    seen = None
    for _ in range(rounds):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.greatest("v", "m").alias("x"), F.least("v", "m").alias("y"), "u", "m")
        small = small.select("x", "y").unionByName(small.select(F.col("u").alias("x"), F.col("m").alias("y")))
        e = written(small.filter("x > y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return roots.unionByName(e.select(F.col("u").alias("node"), F.col("v").alias("component")))


SALTS = 16
#: A name that no table has.
SALT = "_salt_of_heddle"


def let(value: Column, body) -> Column:
    """body(value), with value made once a row even where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def salted_join(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with few, a table with a few rows a key, whose keys may be hot in rows: the tasks that
    read rows deal them to SALTS others.

    Where few is below spark.sql.autoBroadcastJoinThreshold, Spark broadcasts it and shuffles nothing."""
    salted = rows.withColumn(SALT, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    copies = few.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, SALT], how).drop(SALT)
