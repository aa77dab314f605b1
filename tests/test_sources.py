import subprocess

import pytest
from pyspark.sql import functions as F

from heddle.operators import classify
from heddle.sources import porcelain
from heddle.sources.git import GitSource

TEXT = "\n".join([
    "a" * 40 + " 1 1 3", "author Ann", "author-mail <ann@x.org>", "author-time 1234567890", "summary author fake", "filename f", "\tauthor fake\r",
    "b" * 40 + " 2 2", "author Not Committed Yet", "author-mail <not.committed.yet>", "author-time 0", "\t   ",
    "a" * 40 + " 3 3", "author Ann", "author-mail <ann@x.org>", "author-time 1234567890", "\t\tdeep",
]) + "\n"


def test_porcelain(spark):
    rows = porcelain.parse(spark.createDataFrame([("f", TEXT), ("empty", ""), ("none", None)], "path string, porcelain string")).orderBy("line_number").collect()
    assert [(r.path, r.line_number, r.content, r.hash[0], r["name"], r.email, r.commit_date) for r in rows] == [
        ("f", 1, "author fake\r", "a", "Ann", "ann@x.org", "2009-02-13T23:31:30.000Z"), ("f", 2, "\tdeep", "a", "Ann", "ann@x.org", "2009-02-13T23:31:30.000Z"),
    ]


@pytest.fixture
def repository(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Test User", "-c", "user.email=test@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    files = {"product.$id.tsx": 4, "routes/blog/$year-$month-$day.tsx": 2, "$.ident.ts": 3, "café.ts": 2}
    for p, n in files.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("\n\n".join(f"line {i};" for i in range(n)) + "\n")
    run("add", "-A")
    run("commit", "-qm", "first")
    return str(tmp_path), files


def test_git(spark, repository):
    root, files = repository
    spark.dataSource.register(GitSource)
    tracked = classify.classify(spark.read.format("git").option("repository", root).load())
    assert {r.path for r in tracked.collect() if not r.is_binary and not r.is_ignored} == set(files)
    lines = porcelain.parse(spark.read.format("git").option("repository", root).option("what", "blame").load()).collect()
    assert {p: sum(r.path == p for r in lines) for p in files} == files
    assert {(r["name"], r.email) for r in lines} == {("Test User", "test@example.com")}


def test_engine_on_a_repository(spark, repository):
    from heddle.plans import engine, report

    e = engine.Engine.of_git(spark, repository[0])
    stats = e.repository_stats().first()
    assert (stats.total_files, stats.total_lines, stats.total_authors) == (4, 11, 1)
    one = e.author_contributions().first()
    assert (one.total_lines, one.total_files, one.percentage, one["rank"], one.title) == (11, 4, 100.0, 1, "legend")
    assert len(e.author_file_contributions(one.id).collect()) == 4 and e.find_canonical_author("test@example.com") == one.id
    assert "Test User" in report.extended(e) and "product.$id" in report.developer(e, "test@example.com")
    assert e.inactive_authors().count() == 0 and [r.id for r in e.all_authors().collect()] == [one.id]

    e.create_views("own_")
    assert spark.sql("SELECT count(*) AS n FROM own_blame_lines JOIN own_files USING (file_id)").first().n == 11
    assert spark.sql("SELECT count(*) AS n FROM own_authors").first().n == 1 and spark.table("own_author_aliases").count() == 0
    e.drop_views("own_")
    assert not any(t.name.startswith("own_") for t in spark.catalog.listTables())
    assert e.nth_author(1).first().id == one.id and e.nth_author(2).count() == 0
    assert tuple(e.developers().first()) == (1, 1)
    assert report.simple(e).count("Test User") == 1 and report.simple(e, 0).count("Test User") == 0


def test_every_file_is_of_one_kind(spark):
    files = spark.createDataFrame([("a.PNG", 5), ("a.test.ts", 5), ("a.ts", 5), ("b.ts", 10**6), ("c.ts", None), ("d.lock", 10**6)], "path string, size long")
    known = classify.classify(files)
    one = classify.repository_stats(known.withColumn("total_lines", F.lit(1)), spark.range(3)).first()
    assert (one.total_files, one.binary_files, one.ignored_files, one.large_files, one.analyzed_files) == (6, 2, 2, 1, 1)
    assert one.analyzed_files == one.total_files - one.binary_files - one.ignored_files - one.large_files


def test_paths_with_line_breaks(spark, tmp_path):
    from heddle.plans import engine

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=T", "-c", "user.email=t@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "two\nparts.ts").write_text("one\ntwo\n")
    run("add", "-A")
    run("commit", "-qm", "a\ttab in the subject")
    one = engine.Engine.of_git(spark, str(tmp_path)).author_contributions().first()
    assert (one["name"], one.total_lines) == ("T", 2)


def test_command_line(spark, repository, tmp_path, capsys):
    from heddle.__main__ import main

    assert main([str(tmp_path / "none")]) == 1
    assert main([repository[0], "--simple"]) == 0 and "Test User" in capsys.readouterr().out


def commit(root, message="next", **files):
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", f"user.name={message}", "-c", f"user.email={message}@example.com", *a], check=True, capture_output=True)
    for name, text in files.items():
        with open(f"{root}/{name}.ts", "w") as f:
            f.write(text)
    run("add", "-A")
    run("commit", "-qm", message)


def told(engine):
    lines = engine.blame.join(engine.files.select("file_id", "path"), "file_id").join(engine.authors.select(F.col("id").alias("author_id"), "email"), "author_id")
    return sorted((r.path, r.line_number, r.content, r.hash, r.email) for r in lines.collect()), sorted(map(tuple, engine.author_contributions().collect()))


def test_second_analysis_blames_what_changed(spark, tmp_path):
    """Files changed, new, gone, changed back, with changes not committed, under a new mail map, and after history was rewritten."""
    from heddle.plans.engine import Engine

    root, store = str(tmp_path / "tree"), f"file://{tmp_path}/store"
    subprocess.run(["git", "init", "-q", root], check=True)
    commit(root, "ann", a="one\ntwo\n", b="x\ny\n", c="1\n2\n", d="gone\n", e="e\n")
    again = lambda: Engine.of_git(spark, root, store=store, policy="strict")
    assert again().blamed == 5
    assert again().blamed == 0
    commit(root, "bob", a="one\nthree\n", new="n\n", c="1\n2\n3\n")
    commit(root, "cy", c="1\n2\n")  # as it was at first, but its lines were all written again
    subprocess.run(["git", "-C", root, "rm", "-q", "d.ts"], check=True)
    commit(root, "dee")
    second = again()
    assert second.blamed == 3 and told(second) == told(Engine.of_git(spark, root, policy="strict"))
    with open(f"{root}/e.ts", "w") as f:
        f.write("e\nnot committed\n")
    for _ in range(2):  # as long as it has changes
        third = again()
        assert third.blamed == 1
    # its own lines carry no commit: of those the time differs
    assert told(third)[0] == told(Engine.of_git(spark, root, policy="strict"))[0]
    commit(root, "eve", e="e\ncommitted\n")
    assert again().blamed == 1
    with open(f"{root}/.mailmap", "w") as f:
        f.write("Ann Lee <lee@example.com> <ann@example.com>\n")
    fourth = again()
    assert fourth.blamed == 5 and "lee@example.com" in {r[4] for r in told(fourth)[0]}
    commit(root, "map")
    run = ["git", "-C", root, "-c", "user.name=x", "-c", "user.email=x@example.com"]
    subprocess.run([*run, "commit", "-q", "--amend", "-m", "other"], check=True)
    last = again()
    assert told(last) == told(Engine.of_git(spark, root, policy="strict"))


def test_progress_is_what_the_stats_say(spark, repository):
    from heddle.plans.engine import Engine

    heard = {}
    e = Engine.of_git(spark, repository[0], on_progress=lambda phase, counts: heard.update({phase: counts}))
    stats = e.repository_stats().first()
    assert list(heard) == ["files", "lines", "authors"]
    assert heard == {"files": {"files": stats.total_files, "analyzed": stats.analyzed_files}, "lines": {"lines": stats.total_lines}, "authors": {"authors": stats.total_authors}}


def test_path_filters_reach_git(spark, repository, monkeypatch):
    spark.dataSource.register(GitSource)
    root, files = repository
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for what in ("files", "blame"):
            read = spark.read.format("git").option("repository", root).option("what", what).option("pushdown", "true").load()
            found = lambda condition: {r.path for r in read.filter(condition).collect()}  # noqa: E731, B023
            assert found("path = '$.ident.ts'") == {"$.ident.ts"}
            assert found("path IN ('café.ts', 'routes', 'none')") == {"café.ts"}
            assert found("path LIKE 'routes/%'") == {"routes/blog/$year-$month-$day.tsx"}
            assert found("path LIKE 'rout%'") == {"routes/blog/$year-$month-$day.tsx"}
            assert found("path = 'café.ts' AND path LIKE 'routes/%'") == set()
        read = spark.read.format("git").option("repository", root).option("pushdown", "true").load()
        assert "StartsWith" not in read.filter("path LIKE 'routes/%'")._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[0]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_tasks_are_cut_by_bytes(spark, tmp_path):
    from heddle.sources import git

    root = str(tmp_path)
    subprocess.run(["git", "init", "-q", root], check=True)
    commit(root, big="x\n" * 5000, **{f"s{i}": "y\n" for i in range(30)})
    spark.dataSource.register(GitSource)
    files = spark.read.format("git").option("repository", root).load()
    dealt = git.blamed(files, root, task_bytes=4000, task_files=10).withColumn("task", F.spark_partition_id()).collect()
    task = {r.path: r.task for r in dealt}
    assert len(task) == 31 and [t for p, t in task.items() if t == task["big.ts"]] == [task["big.ts"]]
    assert max(list(task.values()).count(t) for t in task.values()) <= 11
    assert git.blamed(files.limit(0), root).count() == 0


@pytest.mark.parametrize("size", ["64b", "300b", "1k", "128m"])
def test_outputs_cut_anywhere(spark, tmp_path, size):
    """Against parse() over whole texts: records across cuts, content that looks like a header or an author, blanks at the end."""
    texts = {
        "a": TEXT * 7, "b/c d": TEXT.replace("author-mail <ann@x.org>", "author-mail <long" + "x" * 400 + "@x.org>") * 3, "empty": "", "one": TEXT[: TEXT.index("\n" + "b" * 40)] + "  \n \n",
        "odd": TEXT.replace("\t\tdeep", "\t" + "c" * 40 + " 1 1 author Z").replace("summary author fake", "summary x\tauthor y\nprevious " + "d" * 40 + " f") * 4, "open": (TEXT * 2).rstrip("\n"),
    }
    for name, text in texts.items():
        (tmp_path / name.replace("/", "%2F").replace(" ", "%20")).write_bytes(text.encode())
    want = porcelain.parse(porcelain.read(spark, str(tmp_path)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = porcelain.parse_files(spark, str(tmp_path)).select(*want.columns)
        rows = sorted(map(str, got.collect()))
        assert rows == sorted(map(str, want.collect())) and len(rows) > 30
        if size == "64b":
            assert spark.read.option("lineSep", porcelain.BETWEEN).text(str(tmp_path)).rdd.getNumPartitions() > 30
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_snapshot_compacts_and_keeps_whole_versions(spark, tmp_path):
    from heddle.plans.snapshots import Snapshot

    schema = "path string, version string"
    asked = []

    def read(some):
        asked.append(sorted(r.path for r in some.collect()))
        return some.select("path", F.concat("path", "version").alias("content"))

    snapshot = Snapshot(spark, f"file://{tmp_path}/s", read, most=2)
    held = {}
    for i in range(6):
        held |= {"a": str(i), f"n{i}": "0"}
        held.pop(f"n{i - 2}", None)
        n = snapshot.refresh(spark.createDataFrame([*held.items(), ("none", None)], schema), {"i": i})
        assert (n, asked[-1]) == (3, ["a", f"n{i}", "none"]) and snapshot.state() == {"i": i}
        assert sorted(r.content for r in snapshot.lines().filter("content is not null").collect()) == sorted(k + v for k, v in held.items())
        assert len(snapshot.versions.latest()[1]["segments"]) <= 2
    assert snapshot.refresh(spark.createDataFrame(list(held.items()), schema)) == 0
    folders = {p.name for p in (tmp_path / "s" / "lines").iterdir()}
    assert len(folders) <= 5  # of the last versions only

    number, now = snapshot.versions.latest()
    with pytest.raises(RuntimeError, match="there already"):
        snapshot.versions.commit(number - 1, now)
    (tmp_path / "s" / "_versions" / f"{number + 1:012d}.json").write_text('{"half')  # another is writing just now
    assert snapshot.versions.latest() == (number, now)
    assert Snapshot(spark, f"file://{tmp_path}/t", read).refresh(spark.createDataFrame([], schema)) == 0


def test_distinct_files_merge_exactly(spark):
    from heddle.operators import ownership

    rows = [(a, f) for a in range(7) for f in range(1, 90000, 11 + a)] + [(9, 5)] * 3
    blame = spark.createDataFrame(rows, "author_id long, file_id long")
    parts = [ownership.file_bitmaps(blame.filter(f"file_id % 3 {which}")) for which in ("= 0", "<> 0", "= 1")]  # the last is counted twice
    merged = ownership.merged_bitmaps(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    again = ownership.merged_bitmaps(merged.unionByName(parts[0]))
    want = {a: len({f for b, f in rows if b == a}) for a in {a for a, _ in rows}}
    assert {r.id: r.total_files for r in ownership.counts_of_bitmaps(again).collect()} == want
    first = ownership.counts_of_bitmaps(ownership.file_bitmaps(blame)).orderBy("id").collect()
    assert first == ownership.line_counts(blame).orderBy("id").select(*first[0].__fields__).collect()


def test_report_as_files(spark, tmp_path):
    from heddle.plans import report
    from heddle.plans.engine import Engine

    rows = [(f"f{i % 50:02}.ts", i, "x", "h", f"n{i % 40:02}q{i % 40:02}", f"m{i % 40}@{i % 40}.org", 1, "d") for i in range(1000)]
    lines = spark.createDataFrame(rows, "path string, line_number int, content string, hash string, name string, email string, epoch long, commit_date string")
    engine = Engine.of(spark.createDataFrame([(f"f{i:02}.ts", 100) for i in range(50)], "path string, size long"), lines, policy="strict")
    report.write(engine, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines() == report.extended(engine).splitlines() and len(files) >= 1
