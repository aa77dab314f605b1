"""Reports as plain text. What a line says is made by Spark; here lines are put together, a few for each author shown."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import scalars as S
from .engine import Engine


def _file_line(file) -> Column:
    cut = S.split_file_name(file["filename"])
    share = F.lpad(F.concat(file["percentage"].cast("string"), F.lit("%")), 4, " ")
    return F.concat(F.lit("   "), S.short_base(cut["base"]), F.lit(" "), F.rpad(cut["ext"], 5, " "), F.lit(" "), share, F.lit(" "), S.ratio(file["author_lines"], file["total_lines"]))


def _author_line() -> Column:
    place = F.when(F.col("rank") == 1, S.medal(F.col("rank"))).otherwise(F.lpad(F.col("rank").cast("string"), 2, " "))
    return F.concat(place, F.lit(" "), F.rpad("display_name", 25, " "), F.lit(" "), S.bar(F.col("percentage"), 20), F.format_string(" %s%% (%s lines) [%s] %s", F.col("percentage").cast("string"), S.thousands(F.col("total_lines")), F.col("title"), F.col("email")))


def _overview() -> Column:
    return F.format_string("Files %s, analyzed %s, binary %s, ignored %s, large %s, lines %s, authors %s", *(S.thousands(F.col(c)) for c in ("total_files", "analyzed_files", "binary_files", "ignored_files", "large_files", "total_lines", "total_authors")))


def overview(engine: Engine) -> str:
    return engine.repository_stats().select(_overview()).first()[0]


def _first(rows: DataFrame, most: int | None) -> Iterator[Row]:
    """Rows as they come, a partition at a time; all where most is None."""
    return (rows if most is None else rows.limit(most)).toLocalIterator()


def extended(engine: Engine, most: int | None = None) -> str:
    """The authors, all or the first `most`, with their five files each."""
    rows = _first(engine.extended_report().select(_author_line(), F.transform("top_files", _file_line)), most)
    return "\n".join([overview(engine), *(x for line, files in rows for x in [line, *(files or [])])])


def simple(engine: Engine, most: int | None = None) -> str:
    return "\n".join([overview(engine), *(r[0] for r in _first(engine.author_contributions().select(_author_line()), most))])


def write(engine: Engine, folder: str) -> None:
    """extended() of all authors as text files, in the order of their names; Spark's tasks write them, so that the driver holds
    no line. The overview is the first line of the first file."""
    rows = engine.extended_report().select(F.col("rank").cast("long").alias("rank"), F.concat(F.array(_author_line()), F.coalesce(F.transform("top_files", _file_line), F.array().cast("array<string>"))).alias("all"))
    rows = rows.select("rank", F.posexplode("all").alias("at", "value"))
    first = engine.repository_stats().select(F.lit(0).cast("long").alias("rank"), F.lit(0).alias("at"), _overview().alias("value"))
    rows.unionByName(first).orderBy("rank", "at").select("value").write.text(folder)


def developer(engine: Engine, email: str) -> str:
    """The author whom the e-mail belongs to, with fifteen files."""
    found = engine.find_canonical_author(email)
    own: DataFrame = engine.author_contributions().filter(F.col("id") == F.lit(found))
    head = [r[0] for r in own.select(_author_line()).collect()]
    files = engine.developer_report(email)
    return "\n".join(head + [r[0] for r in files.select(_file_line({c: F.col(c) for c in files.columns})).collect()])
