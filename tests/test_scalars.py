import pytest
from pyspark.sql import functions as F

from heddle.functions import scalars as S
from heddle.operators import classify


def each(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


FILES = [
    ("a.PNG", 9, "binary"), ("x.svg", 9, "binary"), ("src/app.test.ts", 10, "ignored"), ("src/layout/x.ts", 10, "ignored"), ("about/index.html", 10, "ignored"),
    ("robin/a.py", 10, "ignored"), ("a.logger.ts", 10, "ignored"), ("src/keys.keyboard.ts", 10, "ignored"), ("x.model.ts", 10, "ignored"), ("a~b.txt", 10, "ignored"),
    ("Cargo.lock", 10, "ignored"), ("Debug/x.cs", 10, "analyzed"), ("src/db/schema.ts", 10, "analyzed"), ("public/index.html", 10, "analyzed"), (".gitignore", 10, "analyzed"),
    ("a.ts", 51200, "analyzed"), ("a.ts", 51201, "large"), ("product.$id.tsx", 99, "analyzed"), ("$.ident.ts", 9, "analyzed"), ("gone.ts", None, "binary"),
]


def test_classification(spark):
    rows = spark.createDataFrame([(i, p, s) for i, (p, s, _) in enumerate(FILES)], "i int, path string, size long")
    for r in classify.classify(rows).collect():
        kind = "binary" if r.is_binary else "ignored" if r.is_ignored else "large" if r.is_larger_than_threshold else "analyzed"
        assert kind == FILES[r.i][2], r
        assert r.size == (0 if kind in ("binary", "ignored") else FILES[r.i][1])
        assert (r.is_binary and r.is_ignored) == (FILES[r.i][1] is None)


def test_extension(spark):
    assert each(spark, [".gitignore", "a.", "x.Tar.GZ", "d.ir/file", "..a", "a/b.TS"], "string", S.extension) == [None, ".", ".gz", None, ".a", ".ts"]


def test_thresholds(spark):
    assert each(spark, [1.0, 50.0, 0.0, None, 1.5, 1000.0], "double", S.threshold_bytes) == [1024, 51200, 0, 51200, 1536, 1024000]
    assert each(spark, [None], "double", lambda c: S.threshold_bytes(c, 100)) == [102400]


def test_capitals(spark):
    assert each(spark, ["hello world", "apex predator", "a", "", "ALREADY CAPS", "123numbers"], "string", S.capitalized) == ["Hello world", "Apex predator", "A", "", "ALREADY CAPS", "123numbers"]


def test_percentages(spark):
    rows = spark.createDataFrame([(1, 3), (2, 3), (1, 8), (5, 0)], "a long, b long")
    got = rows.select(S.author_percentage(F.col("a"), F.col("b")), S.file_percentage(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(33.33, 33), (66.67, 67), (12.5, 13), (0.0, 0)]


def test_names(spark):
    assert each(spark, ["Doe, Jane", "a, b, c", "  x   y ", None], "string", S.display_name) == ["Jane Doe", "a, b, c", "x y", None]
    assert each(spark, ["", "  ", "\t", "\r", " ", "x"], "string", S.is_blank) == [True] * 5 + [False]
    assert each(spark, ["Alice Smith", "A. Smith", "Jean-Luc", "O'Neil", ""], "string", S.has_artifacts) == [True, False, False, True, False]


@pytest.mark.parametrize("n,want", [(1, [0]), (2, [0, 49]), (3, [0, 12, 38]), (4, [0, 12, 13, 38]), (5, [0, 12, 13, 14, 38]), (10, [0, 1, *range(12, 18), 38, 39])])
def test_titles(spark, n, want):
    got = spark.range(n).select(S.distributed_index(F.col("id"), F.lit(n))).collect()
    assert [r[0] for r in got] == want


def test_display(spark):
    names = [".env", ".eslintrc.js", "a.b.ts", "Makefile", "x."]
    assert [tuple(x) for x in each(spark, names, "string", S.split_file_name)] == [(".env", ""), (".eslintrc", "js"), ("a.b", "ts"), ("Makefile", ""), ("x", "")]
    assert each(spark, [50.0, 150.0, -3.0, float("nan"), None], "double", lambda c: S.bar(c, 4)) == ["██░░", "████", "░░░░", "░░░░", "░░░░"]
    assert each(spark, [0.2, 50.0], "double", S.segment_width) == [1, 30]
    assert each(spark, ["legend", "PEASANT", "none"], "string", S.title_index) == [0, 49, -1]
    assert each(spark, [0, 1234567890], "long", S.iso_time) == ["1970-01-01T00:00:00.000Z", "2009-02-13T23:31:30.000Z"]


def test_title_range_and_needles(spark):
    assert spark.range(1).select(S.title_range(1, 2)).first()[0] == ["line breaker", "conqueror"]
    from heddle.functions.constants import IGNORED_NEEDLES

    paths = [f"a{n}b" for n in IGNORED_NEEDLES] + [f"a{n[:-1]}" for n in IGNORED_NEEDLES if len(n) > 1] + ["", "plain", "x.ts"]
    got = each(spark, paths, "string", lambda c: c.rlike(S.any_needle(IGNORED_NEEDLES)))
    assert got == [any(n in p for n in IGNORED_NEEDLES) for p in paths]


def test_white_space_is_that_of_scripts(spark):
    assert each(spark, ["Jörg\xa0Müller", "a\u2003\ufeff b", "a\x85b"], "string", S.clean_name) == ["jörg müller", "a b", "ab"]
    assert each(spark, ["Jörg\xa0Müller", "a\u3000b.", "Ann\xa0Lee"], "string", S.has_artifacts) == [False, False, True]
    assert each(spark, ["\xa0\ufeff", "\x85"], "string", S.is_blank) == [True, False]
