"""One repository's tables and the questions asked of them. Files, classified, and authors are written when it is made; lines are
not, but for those of a working tree, which git gives once."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import THRESHOLD_KB
from ..operators import classify, identity, ownership
from ..sources import git, porcelain
from .snapshots import Snapshot

#: Told the phase that has ended, and what was counted in it.
Progress = Callable[[str, dict[str, int]], None]


def rules_of_blame(repository: str) -> str:
    """A hash of what decides names and lines in blame beside the commits: mail maps, ignored revisions, the depth of a clone."""
    try:
        said = git.git(repository, "config", "--get-regexp", r"^(blame|mailmap)\.")
    except git.subprocess.CalledProcessError:
        said = ""
    named = [line.split(" ", 1)[1] for line in said.splitlines() if line.lower().startswith(("mailmap.file ", "blame.ignorerevsfile "))]
    parts = [said, git.git(repository, "rev-parse", "--is-shallow-repository")]
    for name in [".mailmap", *named]:
        path = os.path.join(repository, os.path.expanduser(name))
        if os.path.isfile(path):
            with open(path, errors="replace") as f:
                parts.append(f.read())
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]


def versions_of(files: DataFrame, repository: str, snapshot: Snapshot, head: str, rules: str) -> DataFrame:
    """files (path, size, blob, clean) with version: for a file that no commit since the last refresh touched, the one it had then;
    for others this commit's. Files with changes that are not committed have none. A content that came back counts as touched, as
    its lines belong to other commits now."""
    own = F.when(F.col("clean"), F.concat_ws("@", "blob", F.lit(head), F.lit(rules)))
    last = snapshot.state()
    if last.get("rules") != rules or not git.precedes(repository, last.get("head", ""), head):
        return files.withColumn("version", own)
    touched = files.sparkSession.read.format("git").option("repository", repository).option("what", "touched").option("since", last["head"]).load()
    held = snapshot.index().join(touched, "path", "left_anti").select("path", F.col("version").alias("_held"))
    still = F.col("clean") & F.coalesce(F.startswith("_held", F.concat("blob", F.lit("@"))), F.lit(False))
    return files.join(held, "path", "left").withColumn("version", F.when(still, F.col("_held")).otherwise(own)).drop("_held")


@dataclass
class Engine:
    """blamed: how many files git was asked for; None where it was not."""

    files: DataFrame
    authors: DataFrame
    blame: DataFrame
    blamed: int | None = None

    @classmethod
    def of(cls, files: DataFrame, lines: DataFrame, threshold_kb: float = THRESHOLD_KB, policy: str = "loose", on_progress: Progress | None = None) -> Engine:
        """files (path, size), lines as porcelain.parse() gives them; lines of files that are not analyzed don't count.

        Files are numbered by path, authors by their first line in order of path. on_progress hears of each phase as it ends,
        from counts that its own jobs made on the way."""
        tell = on_progress or (lambda phase, counts: None)
        seen, read, found = Observation(), Observation(), Observation()
        one = F.count(F.lit(1))
        known = classify.classify(files.dropDuplicates(["path"]), threshold_kb * 1024).withColumn("file_id", F.xxhash64("path"))
        known = identity.stored(known.observe(seen, one.alias("files"), F.count_if(F.expr(classify.ANALYZED)).alias("analyzed")))
        tell("files", seen.get)
        lines = lines.join(classify.analyzed(known).select("path", "file_id"), "path")
        first = identity.upsert(lines.observe(read, one.alias("lines")).select("email", "name", F.struct("path", "line_number").alias("ord")))
        tell("lines", read.get)
        authors = identity.stored(identity.normalize(first, policy).observe(found, one.alias("authors")))
        tell("authors", found.get)
        blame = identity.attributed(lines, authors).select("author_id", "file_id", "line_number", "content", "hash", "commit_date")
        return cls(classify.with_total_lines(known, blame), authors, blame)

    @classmethod
    def of_git(cls, spark: SparkSession, repository: str, store: str | None = None, **how) -> Engine:
        """A working tree that all executors see; only analyzed files are blamed, each once.

        store: a folder in which lines stay between analyses. A later one then blames only files that commits since have touched,
        that have changes not committed, or that are new; the result is that of blaming all."""
        spark.dataSource.register(git.GitSource)
        head, rules = git.head(repository), rules_of_blame(repository)
        files = identity.stored(spark.read.format("git").option("repository", repository).load())
        kept = classify.analyzed(classify.classify(files, how.get("threshold_kb", THRESHOLD_KB) * 1024)).select("path", "size", "blob", "clean")
        lines = lambda some: porcelain.parse(git.blamed(some, repository))
        if store is None:
            out, n = identity.stored(lines(kept)), None
        else:
            snapshot = Snapshot(spark, store, lines)
            n = snapshot.refresh(versions_of(kept, repository, snapshot, head, rules), {"head": head, "rules": rules})
            out = snapshot.lines()
        engine = cls.of(files.select("path", "size"), out, **how)
        engine.blamed = n
        return engine

    @classmethod
    def of_porcelain(cls, spark: SparkSession, texts: DataFrame, files: DataFrame, **how) -> Engine:
        """texts (path, porcelain) extracted before, files (path, size)."""
        return cls.of(files, porcelain.parse(texts), **how)

    def repository_stats(self) -> DataFrame:
        return classify.repository_stats(self.files, self.authors)

    def author_contributions(self) -> DataFrame:
        return ownership.contributions(self.authors, self.blame).orderBy("rank")

    def author_file_contributions(self, author_id: int | None = None) -> DataFrame:
        blame = self.blame if author_id is None else self.blame.filter(F.col("author_id") == author_id)
        return ownership.file_contributions(self.files, blame).orderBy(F.desc("author_lines"), "path")

    def all_authors(self) -> DataFrame:
        return identity.all_authors(self.authors)

    def find_canonical_author(self, email: str) -> int | None:
        asked = self.authors.sparkSession.createDataFrame([(email,)], "email string")
        return identity.find_canonical(self.authors, asked).first().canonical_id

    def nth_author(self, n: int) -> DataFrame:
        return ownership.nth(self.author_contributions(), n)

    def developers(self) -> DataFrame:
        return ownership.developers(self.authors, self.blame)

    def inactive_authors(self) -> DataFrame:
        return ownership.inactive(self.authors, self.blame)

    def ranked_authors(self) -> DataFrame:
        return ownership.ranked_authors(self.authors, self.blame)

    def extended_report(self) -> DataFrame:
        return ownership.extended_report(self.authors, self.files, self.blame)

    def developer_report(self, email: str) -> DataFrame:
        return ownership.developer_report(self.authors, self.files, self.blame, email)

    def create_views(self, prefix: str = "") -> None:
        """files, authors, author_aliases and blame_lines for spark.sql()."""
        for name, df in (("files", self.files), ("authors", self.ranked_authors()), ("author_aliases", identity.aliases(self.authors)), ("blame_lines", self.blame)):
            df.createOrReplaceTempView(prefix + name)

    def drop_views(self, prefix: str = "") -> None:
        for name in ("files", "authors", "author_aliases", "blame_lines"):
            self.blame.sparkSession.catalog.dropTempView(prefix + name)
