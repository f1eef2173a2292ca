"""Line de-duplication with levelled sorted runs of line hashes, in DataFrame functions only.

Documents come in batches, largest ids first. A batch's lines are anti-joined with the runs' settled keys (those already found
in enough documents: such lines are known to go), the rest is counted per key and added as a sorted run of its own. Runs of a
level are merged into the next level when there are ``fanout`` of them. Since batches go down in id, the largest id of a
settled key cannot change any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, body, pos, h1, h2): a row per line whose key is long enough; ``body`` tells rows of the same id apart."""
    lines = docs.select("id", F.xxhash64("text").alias("body"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "body", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    # two 64-bit hashes: at 10^12 lines one of them would collide
    return keys.select("id", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class Runs:
    """Levels of runs (h1, h2, n_docs, holder), each a table sorted by hash in the shared folder."""

    def __init__(self, fanout: int):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = [[]]

    def add(self, run: DataFrame) -> None:
        self.levels[0].append(_sorted(run))
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(_sorted(self._merged(runs)))
                self.levels[level] = []

    def merged(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        return self._merged(runs) if runs else None

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))


def _sorted(run: DataFrame) -> DataFrame:
    return cut_lineage(run.sortWithinPartitions("h1", "h2"), "run")


def repeated_lines(lines: DataFrame, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(h1, h2, holder): keys of at least ``min_docs`` documents and the largest id that holds each."""
    cuts = sorted(lines.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else [])
    runs, high = Runs(fanout), None
    for low in [*reversed(cuts), None]:
        batch = lines
        if high is not None:
            batch = batch.where(F.col("id") <= F.lit(int(high)))
        if low is not None:
            batch = batch.where(F.col("id") > F.lit(int(low)))
        high = low if low is not None else high
        found = runs.merged()
        if found is not None:
            # written, so that AQE can broadcast it by size or split the join at a hot line
            settled = cut_lineage(found.where(F.col("n_docs") >= min_docs).select("h1", "h2"), "settled-keys")
            batch = batch.join(settled, ["h1", "h2"], "left_anti")
        per_doc = batch.select("id", "h1", "h2").distinct()
        runs.add(per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("holder")))
    return runs.merged().where(F.col("n_docs") >= min_docs).select("h1", "h2", "holder")


def without_repeated_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """``docs`` with its text rewritten, and the columns ``__n_lines`` and ``__n_dropped`` (both long).

    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose their lines everywhere but in the largest
    id that holds them, where all of them stay. Null and empty texts are one empty line and come back empty. Rows of the same
    id are one document. Null ids together are one document, smaller than all others. All other columns stay as they are.

    Scale: lines are shuffled as two hashes; a hot line is combined before the shuffle, and its joins can be split by AQE. Texts
    are shuffled once, to meet the places of their dropped lines.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    ident = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    source = docs.select(ident.alias("id"), text.alias("text"))
    lines = cut_lineage(keyed_lines(source, min_chars), "lines")
    repeated = cut_lineage(repeated_lines(lines, min_docs, batches, fanout), "repeated-lines")
    gone = (
        lines.join(repeated, ["h1", "h2"])
        .where(F.col("id") < F.col("holder"))
        .groupBy(F.col("id").alias("__id"), F.col("body").alias("__body"))
        .agg(F.array_sort(F.collect_set("pos")).alias("__gone"))
    )
    rows = docs.withColumns({"__id": ident, "__body": F.xxhash64(text)}).join(gone, ["__id", "__body"], "left")
    parts = F.split(text, "\n", -1)
    rows = rows.withColumns({"__lines": parts, "__n_lines": F.size(parts).cast("long")})
    n = F.array_size("__gone")  # null without dropped lines, whatever the ANSI setting
    # kept lines are the slices between dropped ones
    slices = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.get("__gone", i - 1) + 1).alias("a"),
            F.when(i == n, F.size("__lines")).otherwise(F.get("__gone", i)).alias("b"),
        ),
    )
    kept = F.flatten(F.transform(slices, lambda s: F.slice("__lines", s["a"] + 1, s["b"] - s["a"])))
    return rows.withColumns(
        {
            text_column: F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(kept, "\n")),
            "__n_dropped": F.coalesce(n, F.lit(0)).cast("long"),
        }
    ).drop("__id", "__body", "__lines", "__gone")
