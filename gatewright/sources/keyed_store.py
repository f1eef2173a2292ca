"""A versioned store of rows by key: each version adds what changed and lists where every key's row lies.

    <path>/parts/<name>     rows of one publication, never changed
    <path>/index/v=<n>      (keys, fingerprint, part) of every key: version n

A version exists once its index is committed (Spark writes the marker file last), so readers see either the version before or
the whole new one, and whatever a writer that died has left is not listed anywhere. Two writers of one version exclude each other: the
second finds the folder and fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "_SUCCESS"


class KeyedStore:
    """``keys`` name a row; the store also keeps a ``fingerprint`` of what each row was made from."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("repo_id",), most_parts: int = 8):
        self.spark, self.path, self.keys, self.most_parts = spark, path.rstrip("/"), tuple(keys), most_parts

    def _files(self, pattern: str) -> list:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(target)
        return [x.getPath() for x in found or []]

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return sorted(int(p.getParent().getName().split("=")[1]) for p in self._files(f"index/v=*/{MARKER}"))

    def _next(self) -> int:
        """A number above all versions, also those that were never committed."""
        return 1 + max([int(p.getName().split("=")[1]) for p in self._files("index/v=*")], default=0)

    def index(self, version: int | None = None) -> DataFrame | None:
        """(keys, fingerprint, part) of a version, by default the current one; None before the first."""
        there = self.versions()
        if not there:
            return None
        if version is not None and version not in there:
            raise ValueError(f"{self.path} has no version {version}; it has {there}")
        return self.spark.read.parquet(f"{self.path}/index/v={there[-1] if version is None else version}")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, with their fingerprint; None before the first."""
        index = self.index(version)
        if index is None:
            return None
        parts = [r["part"] for r in index.select("part").distinct().collect()]  # at most ``most_parts``
        if not parts:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/parts").parquet(*[f"{self.path}/parts/part={p}" for p in parts])
        return rows.join(index, [*self.keys, "part"]).drop("part")

    def changed(self, fingerprints: DataFrame) -> DataFrame:
        """The rows (keys, fingerprint) whose key is new or whose fingerprint is another than the stored one."""
        index = self.index()
        if index is None:
            return fingerprints
        return fingerprints.join(index.select(*self.keys, "fingerprint"), [*self.keys, "fingerprint"], "left_anti")

    def publish(self, rows: DataFrame, fingerprints: DataFrame) -> int:
        """Make a version in which ``rows`` (one a key) replace those of their keys; the others stay as they are.

        ``fingerprints`` has (keys, fingerprint) of the same keys. Kept rows are not copied, until they lie in more than ``most_parts``
        parts: then all are written as one.
        """
        there, number = self.versions(), self._next()
        name = "p" + uuid.uuid4().hex  # never read as a number
        rows.write.parquet(f"{self.path}/parts/part={name}")
        index = fingerprints.select(*self.keys, "fingerprint").withColumn("part", F.lit(name))
        if there:
            old = self.index(there[-1])
            index = index.unionByName(old.join(index.select(*self.keys), list(self.keys), "left_anti"))
        self._commit(index, number)
        if self.index(number).select("part").distinct().count() > self.most_parts:
            number = self.compact()
        return number

    def compact(self) -> int:
        """A version with the same rows in one part."""
        there, number = self.versions(), self._next()
        name = "p" + uuid.uuid4().hex  # never read as a number
        self.read(there[-1]).drop("fingerprint").write.parquet(f"{self.path}/parts/part={name}")
        self._commit(self.index(there[-1]).withColumn("part", F.lit(name)), number)
        return number

    def _commit(self, index: DataFrame, number: int) -> None:
        index.write.mode("error").parquet(f"{self.path}/index/v={number}")

    def remove_old(self, keep: int = 2) -> None:
        """Delete versions but the last ``keep``, and the parts that no version left lists. Not while a writer is at work."""
        there = self.versions()
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        used = set()
        for number in there[-keep:]:
            used |= {r["part"] for r in self.index(number).select("part").distinct().collect()}
        for number in there[:-keep]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/index/v={number}"), True)
        for part in self._files("parts/part=*"):
            if part.getName().split("=")[1] not in used:
                files.delete(part, True)
