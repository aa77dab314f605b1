"""Quality rules by robust multivariate outliers (operator 5); DataFrame functions only.

Each whole text gets counts (with_stats) and, if it passes the two base rules, a vector: the mean length of its words, the log
of its share of punctuation and symbols, how many words of a block of BLOCK are distinct, and the log of its share of repeated
words and lines. Short texts scatter more, so deviations of the first three from the language's median are multiplied by
sqrt(n / (n + k)) for n words (SOFT has k), and the last is drawn to 6 % by 500 words; no dimension is constant among clean
texts, most of which have no symbols and no repeats. Each unit gets a minimum-covariance-determinant estimate (MCD); documents beyond a chi-square cutoff of Mahalanobis
distance are rejected, as are those that fail a base rule.

Units are language and source; those with fewer than min_rows distinct texts (some ten a dimension at least) use their
language's estimate, then that of all. So do units of no spread, where a dimension's variance given the ones before is below
what rounding leaves (a square of 1/SCALE); where that of all has none either, such a dimension is left out. Copies of a text
in a unit count once in the estimates, so that a large group of them doesn't pass for the unit's spread.

The estimate: from three starts (medians with quartile ranges; means with covariances; medians with the covariance of signs),
concentration steps take the share h of least distance, up to TURNS of them or until no log determinant moves by SETTLED; the start of least
determinant is reweighted once. Distances are held in classes, sixteen to each doubling, summed in the map tasks; the class in
which h falls counts with the weight that makes the share h exactly. Vectors are whole numbers (1/SCALE), so that sums are exact
and a rerun gives the same.

Null and empty texts have no words and fail the base rules; null languages and sources are a unit as any other (that of the
empty string); rows that repeat get a verdict each; an empty table gives no rows; very long texts are read whole. Other columns
stay as they are, whatever their names; columns named like the results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, salted_join, written

SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the vector takes besides: characters of words up to LONGEST each, punctuation, distinct words of whole blocks.
MORE = ["n_lines", "n_capped", "n_marks", "n_fresh"]
SCALE, BLOCK, LONGEST = 1024, 50, 12
SOFT = (200, 400, 200, 0)
TURNS, SETTLED = 20, 0.01
#: Level of the cutoff: the share of rows of a normal distribution that it keeps.
LEVEL = 0.99999
P = len(SOFT)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def repeated_words(hashes: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more. hashes: of the words, in order."""
    n = F.size(hashes)
    tail = lambda a, k: F.slice(a, k, F.greatest(F.size(a) - 2, F.lit(0)))
    windows = F.zip_with(tail(hashes, 1), F.zip_with(tail(hashes, 2), tail(hashes, 3), lambda b, c: F.xxhash64(b, c)), lambda a, bc: F.xxhash64(a, bc))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        def twice(s: Column) -> Column:
            pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
        def spread(at: Column) -> Column:
            steps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(3)))
            return F.aggregate(steps, F.lit(3), lambda x, y: x + y)
        return let(ordered, lambda s: let(twice(s), spread))

    many = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(n < 4, 0).otherwise(many).cast("long")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with STATS, MORE (n_lines: lines with a word) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.drop(*STATS, *MORE, "base_failed").withColumn("_trimmed", F.btrim(t, F.lit(BLANKS)))
    none = F.array().cast("array<struct<h:bigint,n:int>>")
    words = F.transform(F.split("_trimmed", r"[\x20\x09-\x0D]+"), lambda w: F.struct(F.xxhash64(w).alias("h"), F.least(F.length(w), F.lit(LONGEST)).alias("n")))
    out = out.withColumn("_words", F.when(F.col("_trimmed") == "", none).otherwise(words))
    out = out.withColumns({"_hashes": F.col("_words.h"), "_lines": F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")})
    length = F.length("_trimmed")
    blocks = F.sequence(F.lit(0), F.floor(F.size("_hashes") / BLOCK).cast("int") - 1)
    fresh = F.aggregate(blocks, F.lit(0).cast("long"), lambda acc, i: acc + F.size(F.array_distinct(F.slice("_hashes", i * BLOCK + 1, BLOCK))))
    out = out.withColumns({
        "n_words": F.size("_hashes").cast("long"),
        "word_chars": F.length(F.translate("_trimmed", BLANKS, "")).cast("long"),
        "n_symbols": (length - F.length(F.translate("_trimmed", SYMBOLS, ""))).cast("long"),
        "n_marks": (length - F.length(F.translate("_trimmed", PUNCTUATION, ""))).cast("long"),
        "n_capped": F.aggregate("_words", F.lit(0).cast("long"), lambda acc, w: acc + w["n"]),
        "n_fresh": F.when(F.size("_hashes") >= BLOCK, fresh).otherwise(0).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_hashes")),
    }).drop("_trimmed", "_words", "_hashes", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def raw() -> list[Column]:
    """The vector before the language's median is known; of texts that pass the base rules."""
    blocks = F.floor(F.col("n_words") / BLOCK) * BLOCK
    n = F.col("n_words")
    again = F.col("n_repeat_words") + n * F.col("n_dup_lines") / (F.col("n_lines") + 8)
    some = [F.col("n_capped") / n, F.log((F.col("n_marks") + 3 * F.col("n_symbols") + 2) / (F.col("word_chars") + 50)), F.col("n_fresh") / blocks, F.log((again + 30) / (n + 500) + 0.02)]
    return [F.round(x * SCALE).cast("long") for x in some]


def drawn(x: Column, i: int, middle: Column, n: Column) -> Column:
    """x drawn to the middle as far as n words allow."""
    return middle + F.round((x - middle) * F.sqrt(n / (n + SOFT[i]))).cast("long")


def chi2(q: float, k: int) -> float:
    """The quantile q of the chi-square distribution with k degrees of freedom."""
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return low


def chi2_cdf(x: float, k: int) -> float:
    a, z = k / 2, x / 2
    term = total = 1 / a if z else 0.0
    n = a
    while term > 1e-17 * total:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a)) if z else 0.0


def whitened(rows: DataFrame, keep: list[str], factor: float) -> DataFrame:
    """rows (keep.., n, s0.., s00..: sums over n vectors) -> mean m, inverse Cholesky factor w of the covariance, logdet, fit0.."""
    means = [f"s{i} / n AS m{i}" for i in range(P)]
    return factored(rows.selectExpr(*keep, *means, *(f"{factor} * (s{i}{j} / n - m{i} * m{j}) AS v{i}{j}" for i, j in PAIRS)), keep)


def factored(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The same from m and v, the covariance. Variances below those of rounding count as that, and that dimension's fit is false."""
    dot = lambda terms: " + ".join(["0D", *terms])
    out = []  # each refers to those before it
    for i in range(P):
        out += [f"(v{i}{j} - ({dot(f'l{i}{k} * l{j}{k}' for k in range(j))})) / l{j}{j} AS l{i}{j}" for j in range(i)]
        out.append(f"sqrt(greatest(v{i}{i} - ({dot(f'l{i}{k} * l{i}{k}' for k in range(i))}), 1D)) AS l{i}{i}")
    for i in range(P):
        out += [f"-({dot(f'l{i}{k} * w{k}{j}' for k in range(j, i))}) / l{i}{i} AS w{i}{j}" for j in range(i)]
        out.append(f"1 / l{i}{i} AS w{i}{i}")
    out += [f"2 * ({dot(f'ln(l{i}{i})' for i in range(P))}) AS logdet", *(f"l{i}{i} > 1 AS fit{i}" for i in range(P))]
    means = [f"m{i}" for i in range(P)]
    return rows.selectExpr(*keep, *means, *out).select(*keep, *means, *(f"w{i}{j}" for i, j in PAIRS), "logdet", *(f"fit{i}" for i in range(P)))


#: Squared Mahalanobis distance of x0.. by a row of whitened().
DISTANCE2 = " + ".join("pow(" + " + ".join(f"w{i}{j} * (x{j} - m{j})" for j in range(i + 1)) + ", 2)" for i in range(P))
SUMS = {f"s{i}": f"x{i}" for i in range(P)} | {f"s{i}{j}": f"x{i} * x{j}" for i, j in PAIRS}


def units(lang: Column, source: Column) -> Column:
    """Of each language and source, from the smallest to that of all."""
    name = lambda level, x, y: F.concat_ws("\x01", F.lit(level), x, y)
    none = F.lit("")
    return F.array(name("0", lang, source), name("1", lang, none), name("2", none, none))


ADDED = [f"sum({e}) AS {s}" for s, e in SUMS.items()]


def starts_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (unit, x0..) -> (unit, n) and the starts of each unit."""
    quarters = written(rows.groupBy("unit").agg(*map(F.expr, ["count(1) AS n", *(f"percentile(x{i}, array(0.25, 0.5, 0.75)) AS q{i}" for i in range(P)), *ADDED])))
    middle = [f"q{i}[1] AS m{i}" for i in range(P)]
    spread = [f"greatest((q{i}[2] - q{i}[0]) / 1.349, 1D)" for i in range(P)]
    own = ["unit", "start"]
    robust = quarters.selectExpr("unit", "0 AS start", *middle, *(f"pow({spread[i]}, 2) AS v{i}{j}" if i == j else f"0D AS v{i}{j}" for i, j in PAIRS))
    plain = quarters.selectExpr("unit", "1 AS start", "n", *SUMS)
    # signs: directions from the medians, products in millionths so that their sums are exact
    near = salted_join(rows, quarters.selectExpr("unit", *middle, *(f"{s} AS i{i}" for i, s in enumerate(spread))), ["unit"])
    near = near.selectExpr("unit", *(f"(x{i} - m{i}) / i{i} AS z{i}" for i in range(P)), f"greatest({' + '.join(f'z{i} * z{i}' for i in range(P))}, 1e-12D) AS norm")
    signs = near.groupBy("unit").agg(*(F.expr(f"sum(CAST(round(z{i} * z{j} / norm * 1000000) AS BIGINT)) AS u{i}{j}") for i, j in PAIRS))
    signs = quarters.join(signs, "unit").selectExpr("unit", "2 AS start", *middle, *(f"{P} * u{i}{j} / 1000000D / n * {spread[i]} * {spread[j]} AS v{i}{j}" for i, j in PAIRS))
    return quarters.select("unit", "n"), factored(robust, own).unionByName(whitened(plain, own, 1.0)).unionByName(factored(signs, own))


def concentrated(rows: DataFrame, now: DataFrame, h: float) -> DataFrame:
    """One step: mean and covariance of the share h of each unit that is nearest to each start's estimate."""
    near = salted_join(rows, now.drop("logdet"), ["unit"]).withColumn("class", F.expr(f"greatest(-160, least(640, floor(16 * log2({DISTANCE2} + 1e-9D))))"))
    classes = near.groupBy("unit", "start", "class").agg(*map(F.expr, ["count(1) AS n", *ADDED]))
    window = "OVER (PARTITION BY unit, start"  # a row a class
    classes = classes.selectExpr("*", f"sum(n) {window}) AS all", f"sum(n) {window} ORDER BY class) - n AS before")
    classes = classes.selectExpr("*", f"least(1D, (ceil({h}D * all) - before) / n) AS part").filter("part > 0")  # of the class in which h falls
    return whitened(classes.groupBy("unit", "start").agg(*(F.expr(f"sum({c} * part) AS {c}") for c in ("n", *SUMS))), ["unit", "start"], 1.0)


def estimates(vectors: DataFrame, h: float = 0.75, min_rows: int = 50) -> DataFrame:
    """vectors (lang, source, x0..) -> (lang, source, m.., w..) of the unit that stands for each language and source."""
    rows = vectors.select(F.explode(units(F.col("lang"), F.col("source"))).alias("unit"), *(f"x{i}" for i in range(P)))
    sizes, now = starts_of(rows)
    now = written(now)
    for _ in range(TURNS):
        was, now = now, written(concentrated(rows, now, h))
        both = now.select("unit", "start", "logdet").join(was.select("unit", "start", F.col("logdet").alias("was")), ["unit", "start"])
        if both.filter(f"abs(logdet - was) > {SETTLED}").isEmpty():
            break
    best = now.groupBy("unit").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    means = [f"m{i}" for i in range(P)]
    scale = math.sqrt(h / chi2_cdf(chi2(h, P), P + 2))  # consistent at the normal distribution
    now = written(now.join(best, ["unit", "start"]).selectExpr("unit", *means, *(f"w{i}{j} / {scale} AS w{i}{j}" for i, j in PAIRS)))
    cut = chi2(0.975, P)
    inner = salted_join(rows, now, ["unit"]).filter(f"{DISTANCE2} <= {cut}")
    final = whitened(inner.groupBy("unit").agg(*map(F.expr, ["count(1) AS n", *ADDED])), ["unit"], 0.975 / chi2_cdf(cut, P + 2))
    final = written(final.join(sizes, "unit"))
    # each language and source gets the first of its units that will do
    groups = vectors.select("lang", "source").distinct()
    tries = groups.select("lang", "source", F.posexplode(units(F.col("lang"), F.col("source"))).alias("level", "unit"))
    fit = " AND ".join(f"fit{i}" for i in range(P))
    enough = tries.join(final, "unit").filter(f"level = 2 OR (n >= {min_rows} AND {fit})")
    params = means + [f"w{i}{j}" for i, j in PAIRS]
    enough = enough.selectExpr("lang", "source", "level", *means, *(f"CASE WHEN fit{i} THEN w{i}{j} ELSE 0D END AS w{i}{j}" for i, j in PAIRS))
    return written(enough.groupBy("lang", "source").agg(F.min_by(F.struct(*params), "level").alias("e")).select("lang", "source", "e.*"))


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_source": F.coalesce(F.col("source").cast("string"), F.lit(""))})


def middles(stats: DataFrame) -> DataFrame:
    """(lang, c0..): each language's medians, of the documents that pass the base rules."""
    rows = keyed(stats.filter(~F.col("base_failed"))).select(F.col("_lang").alias("lang"), *(x.alias(f"x{i}") for i, x in enumerate(raw())))
    return written(rows.groupBy("lang").agg(*(F.floor(F.percentile(f"x{i}", 0.5)).cast("long").alias(f"c{i}") for i in range(P))))


def vectors_of(stats: DataFrame, middle: DataFrame) -> DataFrame:
    """What estimates() takes: of each language and source, its distinct texts (column _text, a hash) that pass the base rules."""
    rows = keyed(stats.filter(~F.col("base_failed"))).select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), "_text", "n_words", *(x.alias(f"x{i}") for i, x in enumerate(raw())))
    rows = rows.groupBy("lang", "source", "_text").agg(*(F.first(c).alias(c) for c in ("n_words", *(f"x{i}" for i in range(P)))))  # equal in all rows of a text
    near = salted_join(rows, middle, ["lang"])
    return written(near.select("lang", "source", *(drawn(F.col(f"x{i}"), i, F.col(f"c{i}"), F.col("n_words")).alias(f"x{i}") for i in range(P))))


def judged(stats: DataFrame, middle: DataFrame, params: DataFrame, level: float = LEVEL) -> DataFrame:
    """stats (with_stats) with distance (null without an estimate, and for those that fail a base rule) and kept."""
    names = [c for c in stats.columns if c not in ("distance", "kept")]
    few = params.join(middle, "lang").select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(*(c for c in (*params.columns, *middle.columns) if c not in ("lang", "source"))).alias("_e"))
    near = salted_join(keyed(stats.drop("distance", "kept")), few, ["_lang", "_source"], how="left")
    e = lambda name: F.col(f"_e.{name}")
    x = [drawn(r, i, e(f"c{i}"), F.col("n_words")) - e(f"m{i}") for i, r in enumerate(raw())]
    near = near.withColumn("_x", F.when(~F.col("base_failed"), F.array(*x)))
    ys = [sum(e(f"w{i}{j}") * F.col("_x")[j] for j in range(i + 1)) for i in range(P)]
    out = near.withColumn("distance", F.sqrt(sum(y * y for y in ys)))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= math.sqrt(chi2(level, P)))
    return out.withColumn("kept", kept).select(*(f"`{c}`" for c in names), "distance", "kept")


def verdicts(stats: DataFrame, level: float, **how) -> DataFrame:
    """stats (a stored table, with _text) judged by estimates from itself."""
    middle = middles(stats)
    return judged(stats, middle, estimates(vectors_of(stats, middle), **how), level)


def rules(docs: DataFrame, text: str = "text", level: float = LEVEL, **how) -> DataFrame:
    """(doc_id, lang, source, STATS, MORE, base_failed, distance, kept) of every row of docs."""
    stats = with_stats(docs.select("doc_id", "lang", "source", F.col(text).alias("_own")), "_own").withColumn("_text", F.xxhash64("_own"))
    return verdicts(written(stats.drop("_own")), level, **how).drop("_text")


def keep(docs: DataFrame, text: str = "text", level: float = LEVEL, **how) -> DataFrame:
    """The rows of docs that rules() keeps, with their own columns: written once with their counts, judged from there."""
    whole = docs.select(F.col("lang"), F.col("source"), F.col(text).alias("_own"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("_rest"))
    stats = written(with_stats(whole, "_own").withColumn("_text", F.xxhash64("_own")))
    out = verdicts(stats, level, **how).filter("kept")
    return out.select(*((F.col("_own") if c == text else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns))
