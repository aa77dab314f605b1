"""Secret scans: candidates by pattern, false positives removed by a random forest (operator 10); DataFrame functions only.

Candidates of a whole text are values assigned to a name with a word such as token or password, passwords in URLs, text after
"bearer", long strings that mix in digits or both cases, and PEM private keys. Their features are length, transitions between
character classes, distinct characters, coverage by the words of a dictionary, the path (a column, if given) and the words before
and after. The dictionary is the whole words of a tokenizer's vocabulary file, whose path is a parameter. The forest is trained
from labelled findings, a table (candidate, before, after, path, label); made_findings() makes such a table of `rows` rows (a
parameter) from a seed.

Null and empty texts have no candidates; an empty table gives no rows; null paths are empty; each row of docs counts for itself.
Very long texts and candidates are read whole. Where candidates could begin at one place the first kind listed in CANDIDATE wins; those that overlap
go from left to right. Columns that aren't asked for are not read, whatever their names. Offsets are code points from 0.
"""

from __future__ import annotations

import json
import random
import re
import string
from collections.abc import Iterable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import any_needle

NAMES = r"(?i:password|passwd|passphrase|pwd|(?<![a-z])pass|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential)"
SIGN = r"[A-Za-z0-9_-]{0,12}[\"']?[ ]{0,2}(?:=>|[=:])[ ]{0,2}[\"']?"
ASSIGNED = rf"(?<=[=:> \"'])(?!>)(?<={NAMES}{SIGN})[^\s\"'=:,;]{{6,}}+"
URL = r"(?<=:)(?<=://[^\s/@:]{0,64}:)[^\s/@:]{1,200}(?=@)"
BEARER = r"(?<= )(?<=(?i:bearer)[ ]{1,2})[A-Za-z0-9._~+/=-]{8,}+"
#: Not at a name whose value ASSIGNED takes.
UNNAMED = rf"(?<![A-Za-z0-9+/_=-])(?![A-Za-z0-9_-]{{0,20}}{NAMES}[A-Za-z0-9_-]{{0,12}}=[^\s\"'=:,;>]{{6}})"
CASES = UNNAMED + r"(?=[A-Za-z0-9+/_=-]*?[a-z])(?=[A-Za-z0-9+/_=-]*?[A-Z])[A-Za-z0-9+/_=-]{16,}+"
MIXED = UNNAMED + r"(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+"
PEM = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
CANDIDATE = f"{PEM}|{URL}|{BEARER}|{ASSIGNED}|{MIXED}|{CASES}"
#: Cheaper than CANDIDATE, and found in every text in which that is.
GATE = rf"{NAMES}{SIGN}|://[^\s/@:]{{0,64}}:|(?i:bearer) |[A-Za-z0-9+/_=-]{{16}}|-----BEGIN "
AROUND = 48

NEAR = {
    "named": NAMES,
    "hashes": r"(?i:commit|checksum|sha-?[0-9]|md5|digest|etag|uuid|integrity|revision|build)",
    "shown": r"(?i:example|sample|dummy|placeholder|fake|replace|test|such as|for instance)",
    "spoken": r"(?i:bearer|authorization|export|credential|login|sign in|confidential|do not share|rotate|expires|production)",
}
TEST_PATH, LIVE_PATH = r"(?i)test|example|sample|doc|fixture|mock", r"(?i)\.env|secret|config|settings|deploy|prod|credential"


def dictionary(vocabulary: str, least: int = 5) -> list[str]:
    """The words of ASCII letters, of at least so many, in a tokenizer file whose whole words end in </w>: some 20,000."""
    with open(vocabulary, encoding="utf-8") as f:
        own = json.load(f)["model"]["vocab"]
    return sorted({m[1] for k in own if (m := re.fullmatch(rf"([a-z]{{{least},}})</w>", k))})


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, start, candidate, before, after, path), start counted from 0."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")).alias("path"), F.col(text).alias("_t"))
    rows = rows.filter(F.col("_t").rlike(GATE)).withColumn("_found", F.regexp_extract_all("_t", F.lit(CANDIDATE), F.lit(0))).filter(F.size("_found") > 0)
    rows = rows.withColumn("_between", F.split("_t", CANDIDATE, -1)).drop("_t")
    first, second = F.slice("_between", 1, F.size("_found")), F.slice("_between", 2, F.size("_found"))
    rows = rows.withColumn("_parts", F.zip_with(F.arrays_zip(first.alias("a"), F.col("_found").alias("c")), second, lambda x, z: F.struct(F.length(x["a"]).alias("gap"), x["c"].alias("candidate"), F.right(x["a"], F.lit(AROUND)).alias("before"), F.left(z, F.lit(AROUND)).alias("after"))))
    # each start: what lies before, summed along the array
    none = F.array().cast("array<struct<start:bigint,candidate:string,before:string,after:string>>")
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.length(x["candidate"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), x["candidate"], x["before"], x["after"]))).alias("out"),
    )
    few = F.aggregate("_parts", F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return rows.select("doc_id", "path", F.explode(few).alias("x")).select("doc_id", "x.*", "path")


def features(found: DataFrame, words: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """found with one double column for each feature, and their names. words: of the dictionary."""
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]", "-"), "[A-Z]", "U"), "[a-z]", "l"), "[0-9]", "d")
    kinds = F.translate(kinds, "-", "o")
    out = {"f_length": n, "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n}
    found = found.withColumn("_kinds", kinds)
    for a in "lUdo":
        out[f"f_{a}"] = (n - F.length(F.replace("_kinds", F.lit(a), F.lit("")))) / n
        for b in "lUdo":
            if a != b:
                out[f"f_{a}{b}"] = F.regexp_count("_kinds", F.lit(f"{a}(?={b})")) / n
    out["f_runs"] = (n - F.length(F.regexp_replace(c, r"(.)\1+", "$1"))) / n
    out["f_hex"] = c.rlike("^[0-9a-fA-F-]+$").cast("double")
    out["f_words"] = (n - F.length(F.regexp_replace(low, any_needle(words), ""))) / n
    out["f_vowels"] = F.regexp_count(low, F.lit("[aeiou]")) / n
    out["f_pem"] = c.startswith("-----BEGIN").cast("double")
    out["f_digest"] = c.rlike("^sha[0-9]{1,3}[-:]").cast("double")
    out["f_constant"] = c.rlike("^[A-Z_]{4,}=").cast("double")
    out["f_call"] = c.rlike(r"^[$<{(]|[(\[{]").cast("double")
    for name, near in NEAR.items():
        out[f"f_before_{name}"] = F.col("before").rlike(near).cast("double")
        out[f"f_after_{name}"] = F.col("after").rlike(near).cast("double")
    out["f_assigned"] = F.col("before").rlike(rf"{NAMES}{SIGN}$").cast("double")
    out["f_url"] = F.col("before").rlike(r"://[^\s/@:]{0,64}:$").cast("double")
    out["f_bearer"] = F.col("before").rlike(r"(?i:bearer) {1,2}$").cast("double")
    out["f_path_test"] = F.col("path").rlike(TEST_PATH).cast("double")
    out["f_path_live"] = F.col("path").rlike(LIVE_PATH).cast("double")
    return found.withColumns({k: v.cast("double") for k, v in out.items()}).drop("_kinds"), [*out]


def trained(findings: DataFrame, words: Iterable[str], trees: int = 40, depth: int = 9, seed: int = 17) -> RandomForestClassificationModel:
    """findings: (candidate, before, after, path, label 0/1); nulls count as empty."""
    rows, names = features(findings.fillna("", ["candidate", "before", "after", "path"]), words)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=64).fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, words: Iterable[str], threshold: float = 0.5, **columns) -> DataFrame:
    """(doc_id, start, candidate, before, after, path, probability, is_secret), a row a candidate."""
    return judged(candidates(docs, **columns), model, words, threshold)


def judged(found: DataFrame, model: RandomForestClassificationModel, words: Iterable[str], threshold: float = 0.5) -> DataFrame:
    """candidates() with probability and is_secret."""
    rows, names = features(found, words)
    rows = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    rows = rows.withColumn("probability", vector_to_array("probability")[1])
    return rows.select(*found.columns, "probability", (F.col("probability") >= threshold).alias("is_secret"))


def redacted(docs: DataFrame, secrets: DataFrame, text: str = "text", doc_id: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """docs with each of secrets' (doc_id, candidate) written over, longest first."""
    some = secrets.groupBy(F.col("doc_id").alias("_heddle_of")).agg(F.array_sort(F.collect_set("candidate"), lambda a, b: F.length(b) - F.length(a)).alias("_heddle_secrets"))  # as many as the text holds
    out = docs.join(some, F.col(doc_id) == F.col("_heddle_of"), "left")
    clean = F.aggregate(F.coalesce("_heddle_secrets", F.array().cast("array<string>")), F.col(text), lambda t, s: F.replace(t, s, F.lit(mark)))
    return out.withColumn(text, clean).drop("_heddle_of", "_heddle_secrets")


#: Words of the made findings' prose.
PROSE = "the of and to in that is was for with as on by at from this which or have not are be an it their when after before over each some more new also only into two time way work part place case week point number group problem fact".split()


def made_findings(spark: SparkSession, rows: int = 4000, seed: int = 17) -> DataFrame:
    """Labelled findings: keys of several makes in code, URLs, headers and prose, against placeholders, digests, numbers, names, calls
    and paths. Paths and the words around lean to a label without deciding it."""
    r = random.Random(seed)
    of = lambda letters, low, high: "".join(r.choices(letters, k=r.randint(low, high)))
    some = lambda *xs: r.choice(xs)
    prose = lambda: " ".join(r.choices(PROSE, k=r.randint(0, 7)))
    word = lambda: some(*PROSE, of("etaoinshrdlu", 3, 8))
    upper, digits, letters = string.ascii_uppercase, string.digits, string.ascii_letters
    hexa, b62 = digits + "abcdef", letters + digits
    name = lambda: some("", "", "db_", "aws_", "MY_", "client-") + some("password", "passwd", "pwd", "secret", "token", "api_key", "API_KEY", "access_key", "credential", "auth_key", "SECRET_KEY", "passphrase", "private_key")
    sign = lambda: some(" = \"", "=", ": ", ": \"", " = '", ":", " => '", "\": \"")
    live, tests = ("conf/settings.yml", ".env", "deploy/prod.tf", "app/config.py", "secrets/values.yaml"), ("tests/fixtures/x.json", "docs/example.md", "test_login.py", "samples/readme.md", "mock/server.js")
    neutral = ("", "", "", "src0", "src7", "src/app.py", "lib/client.js")
    key = lambda: some(of(hexa, 32, 64), of(b62, 20, 48), of(b62 + "+/", 24, 88), of(b62 + "-_", 22, 44))
    made = lambda: some("AKIA" + of(upper + digits, 16, 16), "ghp_" + of(b62, 36, 36), "xoxb-" + of(digits, 12, 12) + "-" + of(b62, 24, 24), "sk_live_" + of(b62, 24, 24), "AIza" + of(b62 + "-_", 35, 35))
    human = lambda: some(of(b62 + "!#$%*", 8, 16), word() + of(digits, 1, 4) + of("!#$%", 0, 2), word().title() + word() + of(digits, 2, 4), of(letters, 12, 20))
    jwt = lambda: "eyJ" + of(b62, 17, 30) + ".eyJ" + of(b62, 30, 60) + "." + of(b62 + "-_", 43, 43)

    constant = lambda: "_".join(word().upper() for _ in range(r.randint(2, 4)))

    def secret() -> tuple[str, str, str]:
        kind = r.randrange(9)
        if kind == 0:
            return made(), some(" ", f" {name()}{sign()}", " login ", " "), ""
        if kind == 1:
            return human(), f" {some('postgres', 'https', 'amqp', 'mysql', 'redis')}://{word()}:", f"@{word()}.{word()}.net/{word()}"
        if kind == 2:
            return some(jwt(), key()), some(" Authorization: Bearer ", " authorization: bearer ", " -H 'Authorization: Bearer "), some("", "'", '"')
        if kind == 3:
            return f"-----BEGIN {some('', 'RSA ', 'EC ', 'OPENSSH ')}PRIVATE KEY-----", some(" ", "\n", f" {name()}{sign()}"), "\nMII" + of(b62, 30, 40)
        if kind == 4:
            return human(), f" {name()}{sign()}", some('"', "'", "", "\n")
        if kind == 5:
            return of(letters, 16, 40), some(f" {name()}{sign()}", " key ", " login with "), some('"', "")
        return key(), f" {name()}{sign()}" if r.random() < 0.9 else some(" export X=", " sign in with ", " "), some('"', "'", "")

    def other() -> tuple[str, str, str]:
        kind = r.randrange(10)
        if kind == 9:
            return f"{constant()}={word()}{word()}", some(" ", " export ", " set "), some("", "/", ":")
        if kind == 0:
            holder = some("your_token_here", "example-secret", "changeme", "x" * r.randint(8, 30), "*" * r.randint(8, 20), "test_password", "<redacted>", "placeholder1234567", "sample-value-0001", "insert_your_key_here", "REPLACE_ME", "my-secret-token", "00000000000000000000", "1234567890abcdef", "password123")
            return holder, some(f" {name()}{sign()}", f" {name()}{sign()}", f" example: {name()}{sign()}"), some("", '"', " # replace")
        if kind == 1:
            digest = some(of(hexa, 40, 40), of(hexa, 32, 32), of(hexa, 64, 64), "-".join([of(hexa, 8, 8), *(of(hexa, 4, 4) for _ in range(3)), of(hexa, 12, 12)]), some("sha256-", "sha384-", "sha512-") + of(b62 + "+/", 43, 86))
            return digest, some(" commit ", " sha256: ", " md5 ", " etag=", " uuid ", " checksum ", " revision ", " build ", ' integrity="'), some("", " of the build", " is the digest")
        if kind == 2:
            return some(of(digits, 16, 24), of(digits + "-", 16, 24), "20" + of(digits, 12, 14)), some(" ", " number ", " id "), ""
        if kind == 3:
            return some("_", "-").join([word() for _ in range(r.randint(3, 5))] + [of(digits, 1, 4)]), some(" ", " see ", " the file "), ""
        if kind == 4:
            return "/".join([word() for _ in range(r.randint(3, 6))] + [word() + of(digits, 1, 3)]), some(" ", " in ", " src="), ""
        if kind == 5:
            return some("os.environ[X]", "getpass()", "${PASSWORD}", "$TOKEN", f"${{{constant()}}}", f"${constant()}", f"<{word()}-{word()}-key>", "user.password", "settings.SECRET", "config.get(", "process.env.KEY", "{{token}}", "None;", "string;", "required", word() + word()), f" {name()}{sign()}", some("", ")", '"')
        if kind == 6:
            return some("password", "secret", "passwd", "<password>", "hunter", "yourpassword"), f" {some('https', 'postgres')}://{some('user', 'username', 'name')}:", "@localhost/example"
        if kind == 7:
            return some("certificates", "authentication", "of-the-ring", "instruments", word() + word() + word()), some(" the bearer ", " Bearer ", " bearer "), ""
        if r.random() < 0.4:  # a long word, as some languages have
            return "".join(of("etaoinshrdlu", 2, 5) for _ in range(r.randint(4, 8))).title().ljust(16, "e"), some(" ", ". "), some("", ".", ",")
        return "".join(w.title() for w in r.choices(PROSE, k=r.randint(4, 7))) + some("", of(digits, 1, 2)), some(" ", " class ", " call "), some("(", "", ".java")

    out = []
    for _ in range(rows):
        label = r.random() < 0.5
        value, before, after = secret() if label else other()
        shown = not label and r.random() < 0.15
        if shown:  # a key such as the real ones, said to be none or kept for tests
            value, before, after = secret()
        path = r.choice(live if label else tests) if r.random() < (0.9 if shown else 0.3) else r.choice(neutral) if r.random() < 0.8 else r.choice(live + tests)
        before, after = prose() + before, after + " " + prose()
        if shown or r.random() < 0.05:
            if r.random() < 0.5:
                before = some("for example", "a sample", "dummy") + before
            else:
                after += some(" is an example", " is fake", " replace this")
        elif r.random() < (0.25 if label else 0.05):
            after += some(" do not share", " expires soon", " rotate it", " confidential", " in production")
        out.append((value, before[-AROUND:], after[:AROUND], path, int(label)))
    return spark.createDataFrame(out, "candidate string, before string, after string, path string, label int")
