"""Line-porcelain blame text as rows of lines, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: What ends a record, before the next one's first line. Lines end at \n alone, whatever else content and subjects hold.
HEADER = r"\n(?=[0-9a-f]{40,64} [0-9]+ [0-9]+)"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, porcelain) of a folder with one blame output a file, named by the path."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.url_decode("_metadata.file_name").alias("path"), F.col("value").alias("porcelain"))


def emails(text: Column) -> Column:
    """The authors' e-mails of an output's lines that are not blank, one a line."""
    records = F.filter(F.split(S.trimmed(F.coalesce(text, F.lit(""))), HEADER), lambda r: r.rlike(rf"\n\t[{S.SPACE}&&[^\n]]*[^{S.SPACE}]"))
    return F.transform(records, lambda r: S.clean_email(S.trimmed(F.regexp_extract(F.substring_index(r, "\n\t", 1), r"(?dm)^author-mail (.*)$", 1))))


#: What stands between the rows of parse_files(): each has one record from its author on, and the first line of the next.
BETWEEN = "\nauthor "


def parse_files(spark: SparkSession, folder: str, path: Column | None = None) -> DataFrame:
    """The rows of parse(read(folder)), from outputs of any size: files are cut where Spark cuts them, at spark.sql.files.maxPartitionBytes.

    A row of the text source is a record but for its hash, which the row before ends with; rows at a cut get it, and what lines
    are counted before them, from a table of the cuts, one row each."""
    name = F.url_decode("_metadata.file_name") if path is None else path
    raw = spark.read.option("lineSep", BETWEEN).option("recursiveFileLookup", True).text(folder)
    raw = raw.select(name.alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("cut"), F.monotonically_increasing_id().alias("at"), F.split("value", "\n\t", 2).alias("parts"), "value")
    head, then = F.get("parts", 0), F.regexp_extract("value", r"(?d)(?:\A|\n)([0-9a-f]{40,64}) [0-9]+ [0-9]+[^\n]*\n?\z", 1)
    content = F.substring_index(F.coalesce(F.get("parts", 1), F.lit("")), "\n", 1)
    content = F.when(then == "", F.regexp_replace(content, rf"[{S.SPACE}]+\z", "")).otherwise(content)  # the output's end
    rows = raw.select(
        "path", "file", "cut", "at", content.alias("content"), then.alias("then"), S.trimmed(F.substring_index(head, "\n", 1)).alias("name"),
        S.clean_email(S.trimmed(F.regexp_extract(head, r"(?dm)^author-mail (.*)$", 1))).alias("email"), F.regexp_extract(head, r"(?dm)^author-time (-?[0-9]{1,12})", 1).try_cast("long").alias("epoch"),
    ).withColumn("kept", ~S.is_blank(F.col("content")))
    cuts = rows.groupBy("file", "cut").agg(F.count_if("kept").alias("n"), F.max_by("then", "at").alias("last"))
    by_file, by_cut = Window.partitionBy("file").orderBy("cut"), Window.partitionBy("file", "cut").orderBy("at")
    cuts = cuts.select("file", "cut", (F.sum("n").over(by_file) - F.col("n")).alias("before"), F.lag("last").over(by_file).alias("first"))
    rows = rows.withColumn("hash", F.lag("then").over(by_cut)).withColumn("number", F.count_if("kept").over(by_cut)).filter("kept").drop("kept", "then")
    rows = rows.join(cuts, ["file", "cut"]).withColumns({"hash": F.coalesce("hash", "first"), "line_number": (F.col("before") + F.col("number")).cast("int")})
    return rows.select("path", "content", "hash", "name", "email", "epoch", "line_number", S.iso_time(F.col("epoch")).alias("commit_date"))


def parse(texts: DataFrame) -> DataFrame:
    """texts (path, porcelain) -> a row for each line that is not blank: path, line_number (of such lines), content, hash, name,
    email, epoch, commit_date. The output's trailing white space is lost; a carriage return at a line's end is content."""
    at = F.posexplode(F.split(S.trimmed(F.col("porcelain")), HEADER)).alias("pos", "record")
    rows = texts.select("path", at).filter(F.col("record") != "").withColumn("parts", F.split("record", "\n\t", 2))
    head = F.get("parts", 0)
    field = lambda name: S.trimmed(F.regexp_extract(head, rf"(?dm)^{name} (.*)$", 1))
    rows = rows.select(
        "path", "pos", F.substring_index(F.coalesce(F.get("parts", 1), F.lit("")), "\n", 1).alias("content"), F.regexp_extract(head, "^([0-9a-f]+)", 1).alias("hash"),
        field("author").alias("name"), S.clean_email(field("author-mail")).alias("email"), F.regexp_extract(head, r"(?dm)^author-time (-?[0-9]{1,12})", 1).try_cast("long").alias("epoch"),
    ).filter(~S.is_blank(F.col("content")))
    number = F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    return rows.withColumns({"line_number": number, "commit_date": S.iso_time(F.col("epoch"))}).drop("pos")
