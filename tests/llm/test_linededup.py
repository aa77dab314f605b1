import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from heddle.llm import linededup, queries

B = " \t\n\x0b\x0c\r"


def brute(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(B))
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 20:
                held[key(x)].add(d)
    lost = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or lost.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def test_cases(spark):
    long = "This Line is Long enough é"
    rows = [(1, f"{long}\nx\n{long}"), (2, f" {long.replace('T', 't')}\t\nend"), (3, f"a\n{long}\r"), (4, None), (5, ""), (6, "\n\n"),
            (None, long), (None, None), (7, "twenty code points!!\n" * 3), (8, "twenty code points!!"), (9, "nineteen points !!!"), (10, "nineteen points !!!"), (11, "nineteen points !!!"),
            (7, long), (12, "y\n" * 500 + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("z"), "pos": F.lit(1), "_of": F.lit(2), "_lines": F.lit(3)})
    got = linededup.dedup(df, batches=3).select("doc_id", "n_lines", "n_dropped", "text").collect()
    s = lambda v: sorted(map(tuple, v), key=str)
    assert s(got) == s(brute(rows))


def batch(spark, b):
    return spark.range(b * 5, b * 5 + 5).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("h1"), (F.col("id") % 7 * 3).alias("h2"))


def counts(runs):
    return {r.h1: (r.docs, r.last) for r in linededup.merged(runs.all()).collect()}


def test_many_batches_compact_and_open_again(spark):
    runs = linededup.Runs(spark)
    for b in range(6):
        runs.add(batch(spark, b))
    runs.close()
    runs = linededup.Runs(spark.newSession(), runs.folder)  # another session goes on
    for b in range(6, 9):
        runs.add(batch(runs.spark, b))
    assert [len(x) for x in runs.levels] == [1, 2]
    assert counts(runs) == {h: (len(v), max(v)) for h in range(7) for v in [[i for i in range(45) if i % 7 == h]]}
    runs.close()
    assert counts(linededup.Runs(spark, runs.folder)) == {h: (len(v), max(v)) for h in range(7) for v in [[i for i in range(45) if i % 7 == h]]}


def test_runs_are_not_moved_for_a_batch(spark):
    runs = linededup.Runs(spark)
    for b in range(2):
        runs.add(batch(spark, b))
    new = batch(spark, 0).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("last"))
    plan = runs.unsettled(new, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 2 and plan.count("Exchange") == 1  # the batch's own
    assert {r.h1 for r in runs.unsettled(new, 2).collect()} == {3, 4}  # of the five keys, those that few documents hold
    runs.close()


def test_empty_table(spark):
    assert linededup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((a, b, c, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, t in brute(rows))
    assert sorted(map(tuple, queries.op8_linededup(spark, d).collect())) == want
