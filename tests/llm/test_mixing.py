import hashlib
import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from heddle.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, budget, max_epochs, seed, weights):
    """The budgets by pouring into the children that are not yet full, then each leaf's epochs one after another."""
    def domain(source):
        n = "".join(c for c in (source or "") if c.isdigit())
        return "web" if n in ("", *map(str, range(10))) else "curated"

    leaves = defaultdict(list)
    for d, t, lang, source, _ in rows:
        leaves[(domain(source), lang or "", source or "")].append((d, len((t or "").split())))
    cap = Counter()
    for leaf, docs in leaves.items():
        for k in range(4):
            cap[leaf[:k]] += sum(n for _, n in docs) * max_epochs
    given = {(): int(sum(n for v in leaves.values() for _, n in v) * budget)}
    for k, name in enumerate(("domain", "lang", "source")):
        for parent in {leaf[:k] for leaf in leaves}:
            kids = {leaf[: k + 1] for leaf in leaves if leaf[:k] == parent}
            w = {c: weights.get(name, {}).get(c[-1], 1.0) for c in kids}
            left, open_ = float(given[parent]), set(kids)
            while full := {c for c in open_ if cap[c] <= left * w[c] / sum(w[x] for x in open_) + 1e-6}:
                for c in full:
                    given[c] = cap[c]
                    left -= cap[c]
                open_ -= full
            for c in open_:
                given[c] = max(0, int(left * w[c] / sum(w[x] for x in open_) + 1e-6))
    out = Counter()
    for leaf, docs in leaves.items():
        tokens = sum(n for _, n in docs)
        if not tokens:
            continue
        full, rest = divmod(given[leaf], tokens)
        keys = [hashlib.md5(f"{seed}:{full}:{'' if d is None else d}".encode()).hexdigest() for d, _ in docs]
        for (d, n), key in zip(docs, keys):
            before = sum(m for (_, m), k in zip(docs, keys) if k < key)
            out[(d, *leaf)] += full + (before < rest)
    return +out


def rows_of(n, seed=5):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.randint(1, 60)), r.choices(["en", "de", "es", None], [8, 3, 1, 1])[0], r.choices(["src0", "src3", "src11", "books", None], [9, 3, 3, 1, 1])[0], 0) for i in range(n)]
    return [*rows, (None, None, None, None, None), (4, "a b c", "en", "src0", 0), (4, "a b c", "en", "src0", 0), (n, "", "xx", "src0", 0), (n + 1, "w " * 3000, "de", "src3", 0)]


@pytest.mark.parametrize("budget,epochs", [(1.0, 3), (0.4, 1), (5.0, 2)])
def test_against_brute_force(spark, budget, epochs):
    rows = rows_of(400)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"epochs": F.lit("mine"), "cut": F.lit(1), "_salt": F.lit(2), "_times": F.lit(3)})
    out = M.mixed(docs, M.tree(), weights=M.WEIGHTS, budget=budget, max_epochs=epochs, seed=7)
    assert set(docs.columns) < set(out.columns)
    got = Counter((x.doc_id, x._t_domain, x._t_lang, x._t_source) for x in out.collect())
    assert got == brute(rows, budget, epochs, 7, M.WEIGHTS)


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "d string, s string, tokens long")
    got = {(r.d, r.s): r.budget for r in M.budgets(leaves, ["d", "s"], 400 / 2010, {}, 1, 1.0).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}
    got = {(r.d, r.s): r.budget for r in M.budgets(leaves, ["d", "s"], 1.0, {"s": {"y": 0}}, 1, 1.0).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 0, ("b", "z"): 1000}


def test_empty_table(spark):
    assert M.mixed(spark.createDataFrame([], SCHEMA), M.tree(), weights=M.WEIGHTS).count() == 0


def test_sql(spark):
    from heddle.llm import queries as Q

    d = "/root/testdata/sf0.001"
    if not os.path.exists(d):
        pytest.skip("no test tables")
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sql.sql(Q.ORACLES["op1_mixing"]).fetchall()
    got = [tuple(r) for r in Q.op1_mixing(spark, d).select("doc_id", "domain", "lang", "source", "epoch").collect()]
    assert Counter(got) == Counter(map(tuple, want))
