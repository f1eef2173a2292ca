"""An update table in levels: a folder for each batch, merged into larger runs so that readers open few of them.

    <table>/batch=<n>             rows that batch n changed; a replay overwrites it
    <table>/runs/<first>-<last>-<name>   the last row of each key of the batches first to last
    <table>/manifest/v=<n>        the runs that hold now: (folder, level, first, last), version n

A manifest exists once its marker does, which Spark writes last; until then readers use the one before and the batches after it. So a
merge that dies is only an unlisted folder.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "_SUCCESS"


class UpdateTable:
    """``keys`` name a row. ``fanout`` batches, or runs of one level, become a run of the next level."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], fanout: int = 8):
        self.spark, self.path, self.keys, self.fanout = spark, path.rstrip("/"), keys, fanout

    def _files(self, pattern: str) -> list:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(target)
        return [x.getPath() for x in found or []]

    def _numbers(self, pattern: str) -> list[int]:
        return sorted(int(p.getName().split("=")[1]) for p in self._files(pattern))

    def runs(self) -> list[tuple]:
        """(folder, level, first, last) of the current manifest, oldest first; at most ``fanout`` a level."""
        there = sorted(int(p.getParent().getName().split("=")[1]) for p in self._files(f"manifest/v=*/{MARKER}"))
        if not there:
            return []
        rows = self.spark.read.parquet(f"{self.path}/manifest/v={there[-1]}").collect()
        return sorted(((r["folder"], r["level"], r["first"], r["last"]) for r in rows), key=lambda r: r[2])

    def open_batches(self, runs: list[tuple]) -> list[int]:
        """Whole batches that no run holds."""
        after = max((r[3] for r in runs), default=-1)
        return sorted(n for n in (int(p.getParent().getName().split("=")[1]) for p in self._files(f"batch=*/{MARKER}")) if n > after)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Keep a batch, and merge what has become many. A batch that a run already holds is a replay and changes nothing."""
        runs = self.runs()
        if batch_id <= max((r[3] for r in runs), default=-1):
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        self.merge()

    def _rows(self, folders: list[tuple[str, int]]) -> DataFrame:
        """The rows of folders, each with the number of the last batch in it."""
        parts = [self.spark.read.parquet(f"{self.path}/{folder}").withColumn("__last", F.lit(last)) for folder, last in folders]
        return reduce(DataFrame.unionByName, parts)

    def merge(self) -> None:
        """Merge open batches, then runs of a level, as long as there are ``fanout`` of them; one manifest a merge."""
        runs = self.runs()
        batches = self.open_batches(runs)
        if len(batches) >= self.fanout:
            runs = self._replace(runs, [(f"batch={n}", 0, n, n) for n in batches], 1)
        level = 1
        while any(r[1] >= level for r in runs):
            own = [r for r in runs if r[1] == level]
            if len(own) >= self.fanout:
                runs = self._replace([r for r in runs if r[1] != level], own, level + 1)
            level += 1

    def _replace(self, others: list[tuple], merged: list[tuple], level: int) -> list[tuple]:
        first, last = min(r[2] for r in merged), max(r[3] for r in merged)
        folder = f"runs/{first}-{last}-{uuid.uuid4().hex}"
        newest(self._rows([(r[0], r[3]) for r in merged]), self.keys).write.parquet(f"{self.path}/{folder}")
        runs = [*others, (folder, level, first, last)]
        number = 1 + max(self._numbers("manifest/v=*"), default=0)
        table = self.spark.createDataFrame(runs, "folder string, level int, first long, last long").coalesce(1)
        table.write.mode("error").parquet(f"{self.path}/manifest/v={number}")
        return runs

    def folders(self) -> list[tuple[str, int]]:
        """(folder, last batch) of all that a reader opens."""
        runs = self.runs()
        return [(r[0], r[3]) for r in runs] + [(f"batch={n}", n) for n in self.open_batches(runs)]

    def read(self, schema: str) -> DataFrame:
        """Of each key the row of its last batch. An empty table has the columns of ``schema``."""
        folders = self.folders()
        if not folders:
            return self.spark.createDataFrame([], schema)
        return newest(self._rows(folders), self.keys)

    def remove_old(self) -> None:
        """Delete batches and runs that the current manifest replaced. Readers that began before must have ended."""
        runs = self.runs()
        held, after = {r[0] for r in runs}, max((r[3] for r in runs), default=-1)
        gone = [p for p in self._files("batch=*") if int(p.getName().split("=")[1]) <= after]
        gone += [p for p in self._files("runs/*") if f"runs/{p.getName()}" not in held]
        for p in gone:
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the largest ``__last``; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, "__last")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__last").alias("__r")).select(*keys, "__r.*")
