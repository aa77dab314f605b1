import random
import re

import pytest
from pyspark.sql import functions as F

from heddle.operators import identity as I
from heddle.operators import similar

SCHEMA = "id long, name string, email string, display_name string"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    def strings(x, y, email):
        if not x or not y:
            return False
        p, q = (re.sub("[._0-9-]", "", s.lower()) for s in (x, y))
        n = max(len(p), len(q))
        most = min(max(int(n * 0.15), 1), 3) if email else min(max(int(n * 0.4), 2), 6)
        return x == y or p == q or p in q or q in p or lev(p, q) <= most

    clean = lambda s: re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9_\sÀ-ɏ]", "", s)).strip().lower()
    parts = lambda e: (e.lower().split("@") + [""])[:2]
    if a[2].lower() == b[2].lower():
        return True
    if any(strings(clean(x), clean(y), False) for x in (a[1], a[3]) for y in (b[1], b[3])):
        return True
    return parts(a[2])[1] == parts(b[2])[1] and strings(parts(a[2])[0], parts(b[2])[0], True)


def one_by_one(authors):
    seeds, out = [], {}
    for a in sorted(authors):
        s = next((s for s in seeds if alike(s, a)), None)
        if s is None:
            seeds.append(s := a)
        out[a[0]] = s[0]
    return out


@pytest.mark.parametrize("each,heads", [(256, 3), (3, 2), (1, 0)])
def test_greedy_clusters(spark, each, heads):
    r = random.Random(7)
    firsts, lasts = ["Alice", "Bob", "Karolína", "Zygmunt", "Ødegaard", "Q"], ["Smith", "Featherstonehaugh", "Nguyen", "Øst", "Vandermeer-Jones", "o'Neil"]
    rows = []
    for i in range(60):
        name = f"{r.choice(firsts)}{''.join(r.choices('abcdefghijkl', k=r.choice([0, 4, 9])))} {r.choice(lasts)}{''.join(r.choices('mnopqrstuv', k=r.choice([0, 7])))}"
        mail = f"{''.join(r.choices('abcdefgh', k=9))}@{r.choice(['a.org', 'b.com', 'c.net', 'd.io', 'e.eu'])}"
        rows.append((i * 3, name, mail.upper() if i % 9 == 0 else mail, name))
    rows += [(1000, "", "", ""), (1001, "007", "x", "007")]
    got = {x.id: x.seed for x in I.loose_clusters(spark.createDataFrame(rows, SCHEMA), each, heads).collect()}
    assert got == one_by_one(rows) and 1 < len(set(got.values())) < len(rows)


def test_index_finds_every_similar_pair(spark):
    """Against all pairs: short keys, one letter, digits alone, long ones, other scripts, in two groups."""
    r = random.Random(3)
    texts = {"", "a", "b", "ab", "cd", "日", "日本", "𝒳y", *("".join(r.choices("abcdé", k=r.randint(1, 18))) for _ in range(260))}
    texts |= {t[: len(t) // 2] + "x" + t[len(t) // 2 + 1 :] for t in [*texts][:80]} | {t + "yz" for t in [*texts][:40]}
    for rule, most in ((similar.NAME, lambda n: min(max(int(n * 0.4), 2), 6)), (similar.MAIL, lambda n: min(max(int(n * 0.15), 1), 3))):
        rows = [(i, "gh"[i % 2], t) for i, t in enumerate(sorted(texts))]
        keys = spark.createDataFrame(rows, "k long, g string, text string")
        got = {(x.a, x.b) for x in similar.pairs(keys, rule).collect()}
        ways = similar.hubs(keys, rule).collect()
        got |= {(min(x.k, y.k), max(x.k, y.k)) for x in ways for y in ways if x.hub == y.hub and x.enters and y.leaves and x.k != y.k}
        alike = lambda s, t: s in t or t in s or lev(s, t) <= most(max(len(s), len(t)))  # noqa: E731, B023
        assert got == {(i, j) for i, g, s in rows for j, h, t in rows if i < j and g == h and alike(s, t)}


def test_many_authors_in_few_rounds(spark, monkeypatch):
    """What one by one gives, and how many rounds it takes."""
    r = random.Random(11)
    stem = lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    rows = []
    for i in range(600):
        base = rows[r.randrange(len(rows))][1] if rows and r.random() < 0.4 else f"{stem(r.choice([6, 7, 8]))} {stem(r.choice([7, 9, 10]))}"
        at = r.randrange(len(base))
        name = base[:at] + r.choice(["", "x", "yz", base[at]]) + base[at + 1 :] if r.random() < 0.8 else base
        rows.append((i, name, f"{stem(9)}@{r.choice('abcde')}.org", name))
    wrote = []
    monkeypatch.setattr(I, "stored", lambda df, keep=I.stored: wrote.append(df.columns) or keep(df))
    got = {x.id: x.seed for x in I.loose_clusters(spark.createDataFrame(rows, SCHEMA), heads=0).collect()}
    assert got == one_by_one(rows)
    rounds = sum(c == ["id"] for c in wrote) // 2
    assert 2 <= rounds <= 12 and len(set(got.values())) > 150


@pytest.mark.parametrize("a,b,want", [
    (("x", "J@X.org"), ("yyyyyyyyy", "j@x.org"), True), (("Al", "qqqqqqqqq@p"), ("Bo", "zz@q"), True), (("user1", "aaaaaaaaaaa@p"), ("user2", "b@q"), True),
    (("Ann", "a1111@p"), ("Joanne", "b@q"), True), (("007", "cccc@p"), ("Somebody Else", "d@q"), True), (("Alice Smith", "e@p"), ("Alicia Smith", "f@q"), True),
    (("z.tera", "gggg@p"), ("Zytera the Defiler", "hhhh@q"), False), (("Quentin Xavier", "jsmith@p"), ("Bob", "jsmyth@p"), True),
])
def test_similarity(spark, a, b, want):
    rows = spark.createDataFrame([(1, a[0], a[1], a[0]), (2, b[0], b[1], b[0])], SCHEMA)
    assert (len({x.seed for x in I.loose_clusters(rows).collect()}) == 1) == want


@pytest.mark.parametrize("names,best", [(["Al Smith", "Alice Smith"], 0), (["Alice Smith", "A. Smith"], 1), (["Jean-Luc", "Jean-Luc P."], 1), (["J. Doe", "K. Doe"], 0), (["O'Neil", "ONeil"], 0)])
def test_canonical(spark, names, best):
    rows = spark.createDataFrame([(i, n, f"{'same@x' if i else ' Same@X '}", n) for i, n in enumerate(names)], SCHEMA)
    got = I.normalize(rows, "strict").collect()
    assert {x.canonical_id for x in got} == {best} and sum(x.is_canonical for x in got) == 1


def test_lookup(spark):
    rows = spark.createDataFrame([(0, "A. B", "a@x", "A. B"), (1, "ab", "A@x", "ab")], SCHEMA)
    merged = I.normalize(rows, "strict")
    asked = spark.createDataFrame([("a@x",), ("A@x",), ("A@X",)], "email string")
    assert {x.email: x.canonical_id for x in I.find_canonical(merged, asked).collect()} == {"a@x": 0, "A@x": 0, "A@X": None}
    assert I.aliases(merged).first().similarity == 100 and I.all_authors(merged).first().aliases == ["ab"]


def test_upsert(spark):
    rows = spark.createDataFrame([("b@x", "Bea", 2), ("a@x", "Ann, Lee", 3), ("b@x", "Bob", 1)], "email string, name string, ord int")
    got = {x.email: (x.id, x.name, x.display_name) for x in I.upsert(rows).collect()}
    assert got == {"b@x": (1, "Bob", "Bob"), "a@x": (2, "Ann, Lee", "Lee Ann")}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert I.normalize(none).count() == 0 and I.normalize(none.withColumn("x", F.lit(1)), "strict").count() == 0


def test_ids_stay_when_lines_arrive(spark, tmp_path):
    store = I.AuthorStore(spark, f"file://{tmp_path}/authors")
    batch = lambda *rows: spark.createDataFrame([*rows], "email string, name string, ord int")
    assert store.authors().count() == 0 and store.merge(batch()) == 0
    assert store.merge(batch(("b@x", "Bea", 2), ("a@x", "Ann, Lee", 1), ("b@x", "Bob", 3))) == 2
    assert store.merge(batch(("b@x", "Other", 0), ("c@x", "Cy", 9), ("", "None", 8))) == 2
    assert store.merge(batch(("c@x", "Cy", 1))) == 0
    got = {r.email: (r.id, r.name, r.display_name) for r in store.authors().collect()}
    assert got == {"a@x": (1, "Ann, Lee", "Lee Ann"), "b@x": (2, "Bea", "Bea"), "": (3, "None", "None"), "c@x": (4, "Cy", "Cy")}
    assert [r.id for r in store.find("c@x").collect()] == [4] and store.find("C@x").count() == 0


def test_lookup_reads_few_row_groups(spark, tmp_path):
    store = I.AuthorStore(spark, f"file://{tmp_path}/authors")
    seen = spark.range(20000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("email"), F.lit("n").alias("name"), F.col("id").alias("ord"))
    store.merge(seen)
    one = store.find(store.authors().filter("id = 77").first().email)
    one.collect()
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(email" in scan
    leaves = one._jdf.queryExecution().executedPlan().collectLeaves()
    rows = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    assert one.count() == 1 and rows < 10000
