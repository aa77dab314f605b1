import random
from collections import Counter
from datetime import UTC, datetime

from heddle.sources import porcelain
from heddle.streaming import ownership


def record(name, text):
    return f"{'a' * 40} 1 1\nauthor {name}\nauthor-mail <{name}@x>\nauthor-time 5\n\t{text}\n"


def test_newest_outputs_count(spark, tmp_path):
    drop, got = tmp_path / "in", []
    drop.mkdir()
    (drop / "src%2Fa.ts#1").write_text(record("ann", "one") + record("bob", "two"))

    def go():
        q = ownership.maintain(ownership.drops(spark, str(drop)), str(tmp_path / "store"), str(tmp_path / "ck"), lambda df: got.append(sorted((r.path, r.email) for r in porcelain.parse(df).collect())))
        q.awaitTermination()

    go()
    (drop / "src%2Fa.ts#2").write_text(record("bob", "one"))
    (drop / "b.ts").write_text(record("cy", "x"))
    go()
    assert got == [[("src/a.ts", "ann@x"), ("src/a.ts", "bob@x")], [("b.ts", "cy@x"), ("src/a.ts", "bob@x")]]


def test_batches_are_compacted(spark, tmp_path):
    drop, got = tmp_path / "in", []
    drop.mkdir()
    for i in range(7):
        (drop / f"f{i % 3}#{i}").write_text(record(f"p{i}", "x"))
        q = ownership.maintain(ownership.drops(spark, str(drop)), str(tmp_path / "store"), str(tmp_path / "ck"), lambda df: got.append(sorted((r.path, r.email) for r in porcelain.parse(df).collect())), each=2)
        q.awaitTermination()
    assert got[-1] == [("f0", "p6@x"), ("f1", "p4@x"), ("f2", "p5@x")]
    assert sorted(f.name for f in (tmp_path / "store").iterdir()) == ["from=4", "from=6"]


def recount(texts):
    """{(path, email): lines} of the newest outputs."""
    out = Counter()
    for path, names in texts.items():
        for n in names:
            out[path, f"{n}@x"] += 1
    return out


def test_changes_add_up_to_a_full_recount(spark, tmp_path):
    """Files that change, go, come back, arrive late or twice; a batch of few files updates the state of few."""
    schema, r = "path string, porcelain string, modified timestamp", random.Random(5)
    newest, got, told = {}, [], []
    went = []
    for i in range(9):
        rows = []
        for path in [f"f{j}" for j in range(20)] if i == 0 else r.sample([f"f{j}" for j in range(22)], 3):
            names = r.choices("abcd", k=r.choice([0, 1, 5, 40]))
            when = i if r.random() < 0.8 or i == 0 else i - 2.5
            rows.append((path, "".join(record(n, "x") for n in names) + record("z", " "), datetime.fromtimestamp(1e6 + when, UTC)))
            if path not in newest or when >= newest[path][0]:
                newest[path] = (when, names)
        rows += rows[:1]  # the same again
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = ownership.totals(stream, str(tmp_path / "store"), str(tmp_path / "ck"), lambda df: got.append(df.collect()), each=3)
        q.awaitTermination()
        went.append((len({p for p, _, _ in rows}), sum(s.numRowsUpdated for s in q.lastProgress.stateOperators)))
        want = recount({p: names for p, (_, names) in newest.items()})
        assert {(x.path, x.email): x.lines for x in got[-1]} == dict(want) and {x.files for x in got[-1]} == {1}
    assert all(files == updated for files, updated in went) and went[0][0] == 20 and went[-1][0] == 3
    assert sorted(f.name for f in (tmp_path / "store").iterdir()) == ["from=3", "from=6"]
    table = spark.createDataFrame(got[-1], "path string, email string, lines long, files long")
    by = Counter()
    for (_, email), n in want.items():
        by[email] += n
    assert {x.email: x.total_lines for x in ownership.by_author(table).collect()} == dict(by)


def test_state_of_null_paths_and_texts(spark, tmp_path):
    schema = "path string, porcelain string, modified timestamp"
    rows = [(None, record("a", "x"), None), ("f", None, None), ("g", "", datetime.fromtimestamp(5, UTC)), ("h", record("a", "x").replace("author-mail <a@x>\n", ""), None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    got = []
    ownership.totals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "ck"), lambda df: got.append(df.collect())).awaitTermination()
    assert sorted((str(x.path), x.email, x.lines) for x in got[0]) == [("None", "a@x", 1), ("h", "", 1)]


def test_blanks_within_an_output_cost_no_more_than_its_length(spark):
    """A search for blanks at the end that starts at every blank takes the square of 300,000 steps."""
    import time

    from pyspark.sql import functions as F

    text = record("ann", "a" + " " * 300_000 + "b") + record("bob", "x") + " \n　\n"
    rows = spark.createDataFrame([(text,)], "t string").repartition(1)
    rows.select(porcelain.emails(F.lit(record("cy", "x")))).collect()
    began = time.perf_counter()
    assert rows.select(porcelain.emails(F.col("t")).alias("e")).first().e == ["ann@x", "bob@x"]
    assert time.perf_counter() - began < 5
