"""Folders that change by whole versions: readers see one version or the next, never half of one.

A version is a small JSON file below _versions, named by its number; what it names are Parquet folders that nobody changes after
it. The file is created under a name that no other may have, so of two writers that began from the same version one fails."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, number: int):
        return self._path(f"{self.folder}/_versions/{number:012d}.json")

    def numbers(self) -> list[int]:
        top = self._path(f"{self.folder}/_versions")
        if not self._fs.exists(top):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(top) if f.getPath().getName().endswith(".json"))

    def read(self, number: int) -> dict | None:
        """None for a version that is just being written."""
        stream = self._fs.open(self._file(number))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def latest(self) -> tuple[int, dict]:
        """The number and content of the newest whole version; (0, {}) before the first."""
        for n in reversed(self.numbers()):
            if (found := self.read(n)) is not None:
                return n, found
        return 0, {}

    def commit(self, after: int, content: dict) -> int:
        """The next version; fails if another came after the one that this was made from."""
        try:
            stream = self._fs.create(self._file(after + 1), False)
        except Py4JJavaError as e:
            raise RuntimeError(f"{self.folder}: version {after + 1} is there already") from e
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        return after + 1

    def new(self, kind: str) -> str:
        """A folder for a part of the next version, below the given name."""
        return f"{kind}/{uuid.uuid4().hex}"

    def at(self, part: str) -> str:
        return f"{self.folder}/{part}"

    def prune(self, kinds: list[str], keep: int = 2) -> None:
        """Deletes parts that none of the last versions names, and the versions before. Nothing else may be writing."""
        numbers = self.numbers()
        held = json.dumps([self.read(n) for n in numbers[-keep:]])
        for kind in kinds:
            top = self._path(self.at(kind))
            for f in self._fs.listStatus(top) if self._fs.exists(top) else []:
                if f.getPath().getName() not in held:
                    self._fs.delete(f.getPath(), True)
        for n in numbers[:-keep]:
            self._fs.delete(self._file(n), False)
