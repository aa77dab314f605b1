"""Tables that cut lineage: Parquet in the folder that all executors share; and row numbers without a task that holds all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders of local sessions that have no spark.checkpoint.dir.
_LOCAL: dict[str, str] = {}


def home(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own (as in
    tests); a cluster must set it, as executors don't see each other's local folders."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="heddle-")
            context.setCheckpointDir(_LOCAL[context.applicationId])
        base = _LOCAL[context.applicationId]
    return f"{base.rstrip('/')}/heddle-{context.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new folder of this application."""
    return f"{home(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: a lost executor costs no more than a new read of it."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession) -> None:
    """Deletes all that written() and scratch() made in this application; frames that read it are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(home(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a task that sorts or groups all of its own.
ROWS = 1 << 18


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of that many rows at most, dealt by keys to a task for every ROWS, and to spark.sql.shuffle.partitions at least; so tasks stay as
    small as they are however large the table is."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS)), *keys)


def ranged(df: DataFrame, order: list) -> DataFrame:
    """df, written in ranges of an order of columns, each sorted by one task; _part: its range, _at: increases with the order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    return rows.withColumn("_part", F.shiftright("_at", 33).cast("int"))


def before(rows: DataFrame, weight: Column) -> DataFrame:
    """(_part, _start): the sum of a weight over all ranges before each; as many rows as ranges, so small enough for one task and every
    other."""
    sums = rows.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    return F.broadcast(sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_start")))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df, written, with a column that numbers its rows from 1 in an order of columns that has no ties."""
    rows = ranged(df, order)
    within = F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(before(rows, F.lit(1)), "_part").withColumn(name, F.col("_start") + within).drop("_part", "_at", "_start")


def running(df: DataFrame, order: list, name: str, weight: Column) -> DataFrame:
    """df, written, with the sum of a weight (whole numbers) over all rows before each, in an order of columns that has no ties."""
    rows = ranged(df.withColumn("_weight", weight.cast("long")), order)
    within = F.sum("_weight").over(Window.partitionBy("_part").orderBy("_at")) - F.col("_weight")
    out = rows.withColumn("_within", within).join(before(rows, F.col("_weight")), "_part")
    return out.withColumn(name, F.col("_start") + F.col("_within")).drop("_part", "_at", "_weight", "_within", "_start")
