import os
from collections import Counter

import duckdb
import pytest

from heddle.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    if not os.path.exists(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", Q.QUERIES)
def test_same_rows_as_sql(spark, sql, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sql.sql(Q.ORACLES[name])
    assert sorted(rows.columns) == columns
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(rows.select(*(f'"{c}"' for c in columns)).fetchall())


def test_every_line_has_one_owner(spark):
    from heddle.operators import ownership
    from heddle.sources import tables

    t = tables.load(spark, SF)
    got = ownership.contributions(t.authors, t.blame).collect()
    assert sum(r.total_lines for r in got) == sum(r.total_lines for r in t.files.select("total_lines").collect())
    assert sorted(r["rank"] for r in got) == [*range(1, len(got) + 1)]
    ids = {r.id: r for r in t.authors.collect()}
    assert all(ids[r.canonical_id].is_canonical for r in ids.values())


def test_loose_queries_have_merges_and_idle_authors(spark):
    ranked = Q.ranked_authors_loose(spark, SF).collect()
    assert sum(not r.is_canonical for r in ranked) > 30
    assert any(r.is_canonical and r["rank"] is None and r.percentage == 0 for r in ranked)
    assert sum(r.canonical_id % 3 == 2 for r in ranked if not r.is_canonical) > 30  # the readable ones


def test_numbers_are_those_of_the_order(spark):
    from heddle.storage import numbered

    rows = numbered(spark.range(1000).selectExpr("id", "id % 7 AS k"), ["k", "id"], "n").collect()
    assert [r.n for r in sorted(rows, key=lambda r: (r.k, r.id))] == [*range(1, 1001)]
    assert numbered(spark.range(0), ["id"], "n").count() == 0


def test_entry_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/heddle", tmp_path / "heddle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", *(["corpus_pipeline.py"] if os.path.exists(f"{root}/corpus_pipeline.py") else [])):
        shutil.copy(f"{root}/{f}", tmp_path / f)
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert got.stdout.split() == [str(len(Q.QUERIES))] * 2


def test_a_cluster_must_name_the_shared_folder():
    from types import SimpleNamespace

    from heddle import storage

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="local-cluster[2,1,1024]", applicationId="app"))
    with pytest.raises(ValueError):
        storage.home(cluster)


@pytest.mark.parametrize("name", ["porcelain_parse", "porcelain_parse_files"])
def test_lines_of_one_place_are_in_order_of_time(spark, tmp_path, name):
    """Two lines of one order, number and person, before and after second 1,000,000,000, whose digits sort the other way."""
    con = duckdb.connect()
    con.execute("CREATE VIEW part AS SELECT 5::BIGINT AS p_partkey, 'small widget' AS p_name, 'Brand#1' AS p_brand")
    con.execute("CREATE VIEW lineitem AS SELECT 7::BIGINT AS l_orderkey, 5::BIGINT AS l_partkey, 1 AS l_linenumber, unnest([TIMESTAMP '2001-09-10', TIMESTAMP '2001-09-08', TIMESTAMP '1969-12-30']) AS l_shipdate")
    for t in ("part", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = Q.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = con.sql(Q.ORACLES[name]).select(*(f'"{c}"' for c in columns)).fetchall()
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(want)


@pytest.mark.parametrize("loose", [False, True])
def test_tasks_stay_small_as_the_table_grows(spark, monkeypatch, loose):
    """However few shuffle partitions are set, no task joins and groups more than some rows."""
    from heddle import storage
    from heddle.operators import identity
    from heddle.sources import tables

    monkeypatch.setattr(storage, "ROWS", 250, raising=False)
    if loose:
        blame = Q._team_lines(spark, SF, identity.stored(identity.normalize(Q._teams(spark, SF), "loose")))
    else:
        blame = tables.load(spark, SF).blame
    by_task = Counter(r[0] for r in blame.selectExpr("spark_partition_id()").collect())
    assert sum(by_task.values()) > 1000 and max(by_task.values()) < 150
