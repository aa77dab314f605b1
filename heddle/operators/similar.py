"""Which keys of authors are similar, through an index of candidates instead of all pairs.

A key is what a name or an e-mail's local part is compared by. Two are similar if one holds the other or if they are few edits
apart for their length (Rule). Candidates for holding share the shorter key's rarest trigram. Candidates for edits share a
segment: a key cut into one segment more than edits are allowed must keep one of them whole, near its place. Every candidate is
then tested, so that pairs() is exact. Keys that are similar to all, or to all short ones, are told by hubs() in place of pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rule:
    """Edits allowed: a share of the longer key's length, between low and high."""

    share: float
    low: int
    high: int

    def most(self, n: Column) -> Column:
        return F.least(F.greatest(F.floor(n * F.lit(self.share)), F.lit(self.low)), F.lit(self.high)).cast("int")


NAME, MAIL = Rule(0.4, 2, 6), Rule(0.15, 1, 3)


def letters(text: Column) -> Column:
    """64 bits: which letters, by code point modulo 64, it holds."""
    points = F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % 64).cast("int"))))
    return F.aggregate(points, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def start(n: Column, d: Column, i: Column) -> Column:
    """Where segment i of d + 1 of a key of n letters starts; the last ones are longer where they can't be equal."""
    return i * F.floor(n / (d + 1)) + F.greatest(F.lit(0), i - (d + 1 - n % (d + 1)))


def size(n: Column, d: Column, i: Column) -> Column:
    return F.floor(n / (d + 1)) + F.when(i >= d + 1 - n % (d + 1), 1).otherwise(0)


def piece(text: Column, at: Column, n: Column) -> Column:
    return F.substring(text, (at + 1).cast("int"), n.cast("int"))


def grams(keys: DataFrame, q: int) -> DataFrame:
    """keys with gram, each distinct one of q letters."""
    every = F.when(F.col("n") >= q, F.transform(F.sequence(F.lit(0), F.col("n") - q), lambda i: piece(F.col("text"), i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return keys.withColumn("gram", F.explode(F.array_distinct(every)))


def renamed(keys: DataFrame, end: str, *common: str) -> DataFrame:
    return keys.select(*common, *(F.col(c).alias(c + end) for c in keys.columns if c not in common))


def holding(keys: DataFrame) -> DataFrame:
    """(a, b): b holds a, two keys of a group."""
    threes = grams(keys.filter("n >= 3"), 3)
    often = threes.groupBy("g", "gram").agg(F.count(F.lit(1)).alias("often"))
    rarest = threes.join(often, ["g", "gram"]).groupBy("k", "g", "text", "n").agg(F.min_by("gram", F.struct("often", "gram")).alias("gram"))
    small = keys.filter("n between 1 and 2").select("k", "g", "text", "n", F.col("text").alias("gram"))
    asked = renamed(rarest.unionByName(small), "_a", "g", "gram")
    there = threes
    for q in (1, 2):
        there = there.unionByName(grams(keys, q))
    both = asked.join(renamed(there.select("k", "g", "text", "n", "gram"), "_b", "g", "gram"), ["g", "gram"])
    return both.filter("n_a < n_b and contains(text_b, text_a)").select(F.col("k_a").alias("a"), F.col("k_b").alias("b"))


def edited(keys: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): keys of a group, a not longer than b, that are few edits apart."""
    n, d, i = F.col("n"), F.col("d"), F.col("i")
    longer = F.filter(F.sequence(n, n + rule.high), lambda m: m - n <= rule.most(m))
    index = keys.withColumn("d", F.explode(F.array_distinct(F.transform(longer, rule.most)))).filter("n > d").withColumn("i", F.explode(F.sequence(F.lit(0), d)))
    index = index.withColumn("piece", piece(F.col("text"), start(n, d, i), size(n, d, i))).withColumn("m", n)
    m = F.col("m")
    probe = keys.withColumn("d", rule.most(n)).withColumn("m", F.explode(F.sequence(F.greatest(F.lit(1), n - d), n))).filter("m > d").withColumn("i", F.explode(F.sequence(F.lit(0), d)))
    at, more = start(m, d, i), n - m
    first = F.greatest(at - i, at + more - (d - i), F.lit(0))
    last = F.least(at + i, at + more + (d - i), n - size(m, d, i))
    probe = probe.withColumns({"first": first, "last": last}).filter("first <= last").withColumn("at", F.explode(F.sequence("first", "last")))
    probe = probe.withColumn("piece", piece(F.col("text"), F.col("at"), size(m, d, i))).drop("first", "last", "at")
    on = ["g", "d", "i", "m", "piece"]
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much to compare: not to be coalesced
    both = renamed(index, "_a", *on).repartition(parts, *on).join(renamed(probe, "_b", *on).repartition(parts, *on), on)
    # short keys have no segments: beyond the hubs, those that are similar share a letter
    little = renamed(grams(keys.filter(n <= rule.low), 1), "_a", "g", "gram")
    other = renamed(grams(keys.filter((n > rule.low) & (n <= 2 * rule.low)), 1).withColumn("d", rule.most(n)), "_b", "g", "gram").withColumnRenamed("d_b", "d")
    cols = ("k_a", "text_a", "n_a", "set_a", "k_b", "text_b", "n_b", "set_b", "d")
    both = both.select(*cols).unionByName(little.join(other, ["g", "gram"]).filter("n_b - n_a <= d").select(*cols))
    few = F.expr("(n_a < n_b or k_a < k_b) and bit_count(set_a & ~set_b) <= d and bit_count(set_b & ~set_a) <= d")
    near = [F.when(d == k, F.levenshtein("text_a", "text_b", k) >= 0) for k in range(rule.low, rule.high + 1)]  # gives up beyond k edits
    return both.filter(few).filter(F.coalesce(*near)).select(F.col("k_a").alias("a"), F.col("k_b").alias("b"))


def pairs(keys: DataFrame, rule: Rule) -> DataFrame:
    """keys (k, g, text): numbers of distinct keys in groups -> (a, b) of all that are similar in a group but for hubs(), once each."""
    keys = keys.filter("text <> ''").withColumns({"n": F.length("text"), "set": letters(F.col("text"))})
    found = holding(keys.drop("set")).unionByName(edited(keys, rule))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hubs(keys: DataFrame, rule: Rule) -> DataFrame:
    """(k, hub, enters, leaves): every key that enters a hub is similar to every key that leaves it. Of a group: all short keys among
    each other, and an empty one (of a name of digits alone, which all others hold) with all."""
    n, hub = F.length("text"), lambda kind: F.xxhash64(F.lit(kind), F.lit(rule.high), "g")
    short = keys.filter(n <= rule.low).select("k", hub("short").alias("hub"), F.lit(True).alias("enters"), F.lit(True).alias("leaves"))
    groups = keys.filter("text = ''").select("g").distinct()
    odd = keys.join(groups, "g")
    to_all = odd.select("k", hub("to all").alias("hub"), (n == 0).alias("enters"), F.lit(True).alias("leaves"))
    of_all = odd.select("k", hub("of all").alias("hub"), F.lit(True).alias("enters"), (n == 0).alias("leaves"))
    return short.unionByName(to_all).unionByName(of_all)
