"""A git working tree as a Spark data source: its tracked files, their blame outputs, or the paths that a range of commits touched.

spark.dataSource.register(GitSource); spark.read.format("git").option("repository", path).load() gives (path, size, blob, clean):
blob is the content's id in the index, clean tells that the working tree is as the last commit has it. With option("what",
"blame") it gives (path, porcelain), with option("what", "touched") and option("since", commit) the paths of all commits since.
option("pushdown", "true") takes filters on path (equal, in, beginning) into git itself and needs
spark.sql.python.filterPushdown.enabled. The repository must be at the same place for every executor."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..storage import running, written

#: Bytes of source files that one task blames, and files beside them.
TASK_BYTES, TASK_FILES = 1 << 20, 200
SCHEMAS = {"files": "path string, size long, blob string, clean boolean", "blame": "path string, porcelain string", "touched": "path string"}


def git(repository: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", repository, "-c", "core.quotepath=off", *arguments], capture_output=True, check=True).stdout.decode(errors="replace")


def listed(repository: str, *arguments: str) -> list[str]:
    return [p for p in git(repository, *arguments).split("\0") if p]


def tracked(repository: str, specs: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(path, blob) of the index; of files in conflict the first stage."""
    found: dict[str, str] = {}
    for entry in listed(repository, "ls-files", "-s", "-z", "--", *specs):
        head, path = entry.split("\t", 1)
        found.setdefault(path, head.split(" ")[1])
    return list(found.items())


def size_of(repository: str, path: str) -> int | None:
    try:
        return os.stat(os.path.join(repository, path)).st_size
    except OSError:
        return None


def blame(repository: str, path: str) -> str | None:
    """Null for a file that cannot be blamed: it has no lines."""
    try:
        return git(repository, "blame", "-w", "--line-porcelain", "--", path)
    except subprocess.CalledProcessError:
        return None


def head(repository: str) -> str:
    """The last commit; empty before the first."""
    try:
        return git(repository, "rev-parse", "--verify", "-q", "HEAD").strip()
    except subprocess.CalledProcessError:
        return ""


def precedes(repository: str, old: str, new: str) -> bool:
    return bool(old and new) and subprocess.run(["git", "-C", repository, "merge-base", "--is-ancestor", old, new], capture_output=True).returncode == 0


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(0)
        self.files = files


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.what, self.since = options["repository"], options.get("what", "files"), options.get("since", "")
        self.specs: tuple[str, ...] = ()

    def partitions(self) -> list[Files]:
        if self.what == "touched":
            return [Files([])]
        parts: list[Files] = []
        room = 0
        for path, blob in tracked(self.root, self.specs):
            took = (size_of(self.root, path) or 0) if self.what == "blame" else 0
            if not parts or room < took or len(parts[-1].files) >= TASK_FILES:
                parts.append(Files([]))
                room = TASK_BYTES
            parts[-1].files.append((path, blob))
            room -= took
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        if self.what == "touched":
            for path in {*listed(self.root, "log", "-m", "--no-renames", "--name-only", "--format=", "-z", f"{self.since}..HEAD")}:
                yield (path.lstrip("\n"),)
        elif self.what == "blame":
            for path, _ in partition.files:
                if (text := blame(self.root, path)) is not None:
                    yield path, text
        elif partition.files:
            changed = {*listed(self.root, "diff-index", "--name-only", "-z", "HEAD")} if head(self.root) else None
            for path, blob in partition.files:
                yield path, size_of(self.root, path), blob, changed is not None and path not in changed


class PushingReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Of filters on the path one is left to git, which lists fewer files then; Spark tests all others."""
        for f in filters:
            on_path = getattr(f, "attribute", None) == ("path",) and not self.specs and self.what != "touched"
            if on_path and isinstance(f, EqualTo):
                self.specs = (f":(literal){f.value}",)
            elif on_path and isinstance(f, In):
                self.specs = tuple(f":(literal){v}" for v in f.value if v is not None) or (":(literal)/",)
            elif on_path and isinstance(f, StringStartsWith) and f.value.endswith("/"):
                self.specs = (f":(literal){f.value}",)
                continue
            yield f  # a path spec also matches all below a folder of that name


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "files")]

    def reader(self, schema) -> Reader:
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else Reader)(self.options)


def blamed(files: DataFrame, repository: str, task_bytes: int = TASK_BYTES, task_files: int = TASK_FILES) -> DataFrame:
    """files (path, size) -> (path, porcelain) of those that can be blamed. No path comes to the driver; files are dealt to tasks
    by their bytes, largest first, so that a large file has a task to itself."""

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for path in b.column("path").to_pylist():
                if (text := blame(repository, path)) is not None:
                    yield pa.RecordBatch.from_pydict({"path": [path], "porcelain": [text]})

    cost = F.coalesce(F.col("size"), F.lit(0)) + F.lit(max(1, task_bytes // task_files))
    before = running(files.select("path", "size"), [F.desc("size"), "path"], "_before", cost)
    dealt = written(before.select("path", F.floor((F.col("_before") + cost / 2) / task_bytes).cast("int").alias("_task")))
    last = dealt.agg(F.max("_task")).first()[0]
    if last is None:
        return files.sparkSession.createDataFrame([], SCHEMAS["blame"])
    return dealt.repartitionById(last + 1, "_task").select("path").mapInArrow(of, SCHEMAS["blame"])
