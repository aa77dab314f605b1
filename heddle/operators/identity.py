"""Who an author is: rows for e-mails, clusters of similar authors, and the one that stands for each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import numbered
from ..storage import written as stored
from ..versions import Versions
from . import similar

#: Authors that one round folds into seeds, all that a task or a broadcast holds of other authors; such rounds before the index.
ROUND, HEADS = 256, 3
AUTHORS = "id long, name string, email string, display_name string"


def upsert(seen: DataFrame) -> DataFrame:
    """seen (email, name, and ord, any orderable column) -> authors (id, name, email, display_name), one for each e-mail as it
    is written. The name is the first seen, ids count by first appearance."""
    first = seen.groupBy("email").agg(F.min(F.struct("ord", "name")).alias("f"))
    return numbered(first, ["f.ord", "email"], "id").select("id", F.col("f.name").alias("name"), "email", S.display_name(F.col("f.name")).alias("display_name"))


class AuthorStore:
    """Authors kept in a folder, to which batches of lines add those not seen before; ids and names never change.

    A merge writes its new authors beside the others and then a version that names them all (heddle.versions), so that readers
    see whole batches only, and a batch that is merged again adds nothing. Files are sorted by e-mail, with Bloom filters and small
    pages, so that a lookup reads one page of the files that may have it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def authors(self) -> DataFrame:
        """(id, name, email, display_name)"""
        _, now = self.versions.latest()
        parts = [self.versions.at(p) for p in now.get("parts", [])]
        return self.spark.read.schema(AUTHORS).parquet(*parts) if parts else self.spark.createDataFrame([], AUTHORS)

    def merge(self, seen: DataFrame) -> int:
        """seen (email, name, ord) as upsert() takes it; how many authors are new. Their ids go on from the largest."""
        number, now = self.versions.latest()
        first = seen.groupBy("email").agg(F.min(F.struct("ord", "name")).alias("f"))
        first = first.join(self.authors().select("email"), "email", "left_anti").select("email", "f.ord", "f.name")
        last = now.get("last", 0)
        new = upsert(first).withColumn("id", F.col("id") + last)
        part = self.versions.new("authors")
        layout = {"parquet.bloom.filter.enabled#email": "true", "parquet.page.row.count.limit": "2000"}
        new.repartitionByRange("email").sortWithinPartitions("email").write.options(**layout).parquet(self.versions.at(part))
        n = (self.spark.read.schema(AUTHORS).parquet(self.versions.at(part)).agg(F.max("id")).first()[0] or last) - last
        if n:
            self.versions.commit(number, {"parts": [*now.get("parts", []), part], "last": last + n})
        return n

    def find(self, email: str) -> DataFrame:
        """The author of just this e-mail; row groups whose Bloom filter or range has no such e-mail are not read."""
        return self.authors().filter(F.col("email") == email)


def strings_similar(a: Column, b: Column, email: bool) -> Column:
    """Equal, equal without digits and . _ -, one within the other, or few edits apart for their length."""
    x, y = S.compare_key(a), S.compare_key(b)
    share, low, high = (0.15, 1, 3) if email else (0.4, 2, 6)
    most = F.least(F.greatest(F.floor(F.greatest(F.length(x), F.length(y)) * F.lit(share)), F.lit(low)), F.lit(high))
    return (a != "") & (b != "") & ((a == b) | (x == y) | F.contains(x, y) | F.contains(y, x) | (F.levenshtein(x, y) <= most))


def authors_similar(a: Column, b: Column) -> Column:
    """Of structs (id, name, display, email, local, domain) as prepared() makes them."""
    names = [strings_similar(a[p], b[q], False) for p in ("name", "display") for q in ("name", "display")]
    mail = (a["domain"] == b["domain"]) & strings_similar(a["local"], b["local"], True)
    return (a["email"] == b["email"]) | S.any_of(names) | mail


def prepared(authors: DataFrame) -> DataFrame:
    """(id, key): what authors are compared by."""
    return authors.select("id", F.struct("id", S.clean_name(F.col("name")).alias("name"), S.clean_name(F.col("display_name")).alias("display"), F.lower("email").alias("email"), S.email_part(F.col("email"), 0).alias("local"), S.email_part(F.col("email"), 1).alias("domain")).alias("key"))


def first_seeds(rest: DataFrame, each: int) -> DataFrame:
    """rest (id, key) with seed, null where it is not decided: the first `each` authors are folded into seeds, one after another,
    and these claim what is like them among all others; no task holds more than that many authors."""
    head = rest.orderBy("id").limit(each).agg(F.array_sort(F.collect_list("key")).alias("head"))
    fold = F.aggregate("head", F.filter("head", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda s: authors_similar(s, x)), acc).otherwise(F.concat(acc, F.array(x))))
    seeds = stored(head.select(fold.alias("seeds")))
    tried = rest.crossJoin(F.broadcast(seeds))  # one row of at most `each` seeds
    first = F.get(F.filter("seeds", lambda s: (s["id"] <= F.col("id")) & authors_similar(s, F.col("key"))), 0)["id"]
    return stored(tried.select("id", "key", F.coalesce(F.when(F.exists("seeds", lambda s: s["id"] == F.col("id")), F.col("id")), first).alias("seed")))


def all_at_once(rest: DataFrame) -> DataFrame:
    """(id, seed) of all authors (id, key), through the index of similar keys.

    In each round every undecided author without an undecided smaller one like them becomes a seed, and all that are like a seed
    are decided: what one after another would give. The rounds' number is the longest chain of authors each waiting for the one
    before, which grows slowly with their number. Keys are numbered; authors only meet through keys."""
    key = F.col("key")
    name = lambda c: F.when(c != "", F.struct(F.lit("name").alias("kind"), F.lit("").alias("g"), S.compare_key(c).alias("text")))
    mail = F.when(key["local"] != "", F.struct(F.lit("mail").alias("kind"), key["domain"].alias("g"), S.compare_key(key["local"]).alias("text")))
    same = F.when(key["email"].isNotNull(), F.struct(F.lit("same").alias("kind"), F.lit("").alias("g"), key["email"].alias("text")))
    has = rest.select("id", F.explode(F.array_distinct(F.array_compact(F.array(name(key["name"]), name(key["display"]), mail, same)))).alias("key")).select("id", "key.*")
    known = stored(numbered(has.select("kind", "g", "text").distinct(), ["kind", "g", "text"], "k"))
    of = stored(has.join(known, ["kind", "g", "text"]).select("id", "k"))
    rules = {"name": similar.NAME, "mail": similar.MAIL}
    some = {kind: known.filter(F.col("kind") == kind).drop("kind") for kind in rules}
    links = stored(reduce(DataFrame.unionByName, [similar.pairs(some[kind], rule) for kind, rule in rules.items()]))
    hubs = stored(reduce(DataFrame.unionByName, [similar.hubs(some[kind], rule) for kind, rule in rules.items()]))

    def least(ids: DataFrame) -> DataFrame:
        """(id, least) of each author: the least of these ids that are like them."""
        own = of.join(ids, "id").groupBy("k").agg(F.min("id").alias("least"))
        by_hub = own.join(hubs.filter("enters"), "k").groupBy("hub").agg(F.min("least").alias("least"))
        ways = own.unionByName(own.join(links, F.col("k") == F.col("a")).select(F.col("b").alias("k"), "least"))
        ways = ways.unionByName(own.join(links, F.col("k") == F.col("b")).select(F.col("a").alias("k"), "least"))
        ways = ways.unionByName(by_hub.join(hubs.filter("leaves"), "hub").select("k", "least"))
        return of.join(ways.groupBy("k").agg(F.min("least").alias("least")), "k").groupBy("id").agg(F.min("least").alias("least"))

    keyless = rest.select("id").join(of.select("id").distinct(), "id", "left_anti")
    parts, open_ = [keyless], stored(of.select("id").distinct())
    while not open_.isEmpty():
        new = stored(least(open_).filter("least = id").select("id").join(open_, "id", "left_semi"))
        parts.append(new)
        open_ = stored(open_.join(least(new).select("id"), "id", "left_anti"))
    seeds = reduce(DataFrame.unionByName, parts)
    return least(seeds).select("id", F.col("least").alias("seed")).unionByName(keyless.select("id", F.col("id").alias("seed")))


def loose_clusters(authors: DataFrame, each: int = ROUND, heads: int = HEADS) -> DataFrame:
    """(id, seed): in the order of ids, an author who is like no seed before becomes one; the others belong to the first like them.

    The first authors are gone through `each` at a time, `heads` times, which ends most small tables and takes what is like many
    out of large ones; what is left is decided through an index. The result is that of going through all one by one."""
    spark, rest, parts = authors.sparkSession, stored(prepared(authors)), []
    for _ in range(heads):
        if rest.isEmpty():
            break
        tried = first_seeds(rest, each)
        parts.append(tried.filter("seed is not null").select("id", "seed"))
        rest = tried.filter("seed is null").select("id", "key")
    if not rest.isEmpty():
        parts.append(stored(all_at_once(rest)))
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "id long, seed long"))


def strict_clusters(authors: DataFrame) -> DataFrame:
    """authors with seed: the first of the same e-mail, blanks around it and case aside."""
    return authors.withColumn("seed", F.min("id").over(Window.partitionBy(F.lower(S.trimmed(F.col("email"))))))


def normalize(authors: DataFrame, policy: str = "loose") -> DataFrame:
    """authors with canonical_id and is_canonical. Of a cluster's readable members the longest display name is canonical, the
    first among equals; where none is readable, the first member."""
    both = {"loose": lambda a: a.join(loose_clusters(a), "id"), "strict": strict_clusters}[policy](authors)
    readable = ~S.has_artifacts(F.col("name")) & ~S.has_artifacts(F.col("display_name"))
    worth = F.struct(readable, F.when(readable, F.length("display_name")).otherwise(0), -F.col("id"))
    both = both.withColumn("canonical_id", F.max_by("id", worth).over(Window.partitionBy("seed"))).drop("seed")
    return both.withColumn("is_canonical", F.col("canonical_id") == F.col("id"))


def attributed(lines: DataFrame, authors: DataFrame) -> DataFrame:
    """lines (email, ..) with author_id, the canonical author of each."""
    return lines.join(authors.select("email", F.col("canonical_id").alias("author_id")), "email")


def repointed(blame: DataFrame, authors: DataFrame) -> DataFrame:
    """blame with the canonical author of each line."""
    mapping = authors.select(F.col("id").alias("author_id"), "canonical_id")
    return blame.join(mapping, "author_id").withColumn("author_id", F.col("canonical_id")).drop("canonical_id")


def aliases(authors: DataFrame) -> DataFrame:
    """A row for each author who was merged into another; similarity is 100 in all of them."""
    return authors.filter("NOT is_canonical").select(F.col("canonical_id").alias("canonical_author_id"), F.col("name").alias("alias_name"), F.col("email").alias("alias_email"), F.lit(100).alias("similarity"))


def all_authors(authors: DataFrame) -> DataFrame:
    """Canonical authors by display name, with the names of their aliases in order."""
    names = aliases(authors).groupBy(F.col("canonical_author_id").alias("id")).agg(F.array_sort(F.collect_list("alias_name")).alias("aliases"))
    out = authors.filter("is_canonical").select("id", "name", "email", "display_name").join(names, "id", "left")
    return out.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).orderBy("display_name", "id")


def find_canonical(authors: DataFrame, emails: DataFrame) -> DataFrame:
    """emails (email) with canonical_id: that of the canonical author of just this e-mail, else of the alias, else null."""
    own = authors.filter("is_canonical").select("email", F.col("id").alias("_own"))
    other = aliases(authors).select(F.col("alias_email").alias("email"), F.col("canonical_author_id").alias("_other"))
    return emails.join(own, "email", "left").join(other, "email", "left").select("email", F.coalesce("_own", "_other").alias("canonical_id"))
