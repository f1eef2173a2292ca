"""Records of large single files: JSON arrays cut while they inflate, quoted CSV cut by quote parity of its blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewright.session import cut_lineage

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_BATCH = 4096
#: Blocks whose parities are broadcast at most: some 200 bytes each.
BROADCAST_BLOCKS = 100_000


# --- JSON arrays ------------------------------------------------------------------------------------------------------


class ArrayCutter:
    """Cuts one JSON array of objects into its objects, from pieces of text that each ended at a ``}``."""

    def __init__(self, name: str):
        if not name.endswith(".gz"):
            raise ValueError(f"{name}: only gzip files are sure to be read in one piece")
        self.name, self.held = name, ""

    def add(self, piece: str) -> str | None:
        """The object that this piece (and its brace) ends, if it does."""
        self.held += piece + "}"
        bare = _STRING.sub("", self.held)
        if '"' in bare:  # the brace stands inside a string
            return None
        if bare.count("{") > bare.count("}"):  # it ends an inner object
            return None
        at = self.held.find("{")
        if self.held[:at].strip(" \t\r\n,[") or bare.count("{") < bare.count("}"):
            raise ValueError(f"{self.name}: not an array of objects at {self.held[:40]!r}")
        record, self.held = self.held[at:], ""
        return record

    def end(self, rest: str) -> None:
        """What follows the last brace must end the array."""
        if (self.held + rest).strip(" \t\r\n,[]") or "]" not in rest:
            raise ValueError(f"{self.name}: cut off at {(self.held + rest)[-40:]!r}")


def _file_runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(values, files) of each run of rows of one file."""
    values, files = batch.column("value"), batch.column("file")
    codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else []
    for low, high in zip(edges, edges[1:]):
        yield values.slice(low, high - low), files.slice(low, high - low)


def _records(values: pa.Array, files: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([values, files.slice(0, len(values))], names=["value", "file"])


def _cut_pieces(cutter: ArrayCutter, pieces: pa.Array) -> Iterator[pa.Array]:
    """The objects that pieces, each with its brace, end. Runs of pieces that are whole flat objects without escapes are taken as
    columns; the cutter sees the others, and those that follow an open object."""
    bare = pc.ascii_ltrim(pieces, characters=" \t\r\n,[")
    flat = pc.and_(pc.starts_with(bare, "{"), pc.equal(pc.count_substring(bare, "{"), 1))
    closed = pc.equal(pc.bit_wise_and(pc.count_substring(bare, '"'), 1), 0)
    plain = pc.and_(pc.and_(flat, closed), pc.invert(pc.match_substring(bare, "\\"))).to_numpy(zero_copy_only=False)
    stops = np.flatnonzero(~plain)
    texts = pieces.to_pylist() if len(stops) or cutter.held else []
    at, held = 0, []
    while at < len(plain):
        if plain[at] and not cutter.held:
            if held:
                yield pa.array(held, pa.string())
                held = []
            after = np.searchsorted(stops, at)
            upto = int(stops[after]) if after < len(stops) else len(plain)
            yield pc.binary_join_element_wise(bare.slice(at, upto - at), "}", "")
            at = upto
            continue
        if (record := cutter.add(texts[at])) is not None:
            held.append(record)
        at += 1
    if held:
        yield pa.array(held, pa.string())


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): each object of the JSON arrays in the files of ``path`` as text.

    A gzip file is inflated by one task, as it must be, but never held: the reader hands on a piece at each closing brace, and
    pieces are put together to one object at a time. So memory follows the largest object, not the file. Files without bytes and
    empty arrays have no rows; anything but one array of objects is an error, as is a file that ends early. Files that are not
    gzip are errors: Spark may split them in the middle of an object.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, last = None, None
        for batch in batches:
            for values, files in _file_runs(batch):
                file = files[0].as_py()
                if cutter is None or cutter.name != file:
                    if cutter is not None:
                        cutter.end(last)
                    cutter, last = ArrayCutter(file), None
                # the last piece of a file has no brace behind it, so each batch's last one waits
                if last is not None and (record := cutter.add(last)) is not None:
                    yield _records(pa.array([record]), files)
                for records in _cut_pieces(cutter, values[:-1]):
                    yield _records(records, files)
                last = values[-1].as_py()
        if cutter is not None:
            cutter.end(last)

    return pieces.mapInArrow(cut, "value string, file string")


# --- quoted CSV -------------------------------------------------------------------------------------------------------


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(file, block, line, value): each record of the CSV files of ``path`` as text, line breaks inside quotes included.

    Spark splits the files into blocks at line ends, which may lie inside a quoted cell. A first pass counts each block's quotes; whether a
    block starts inside a cell is the parity of all quotes of its file before it. With that, each block's records are cut by its own
    task, and only a record that reaches over a block's end is put together from the pieces that blocks hold of it. A file
    of any size is thus read by as many tasks as it has blocks. Quotes in cells are doubled, and only quoted cells hold quotes.
    The first record of each file is its header and left out if ``header``; blank lines outside quotes are no records.

    The blocks' parities are a row a block: they are broadcast up to ``BROADCAST_BLOCKS`` of them. Beyond that the lines are
    joined with them in a shuffle by block, and sorted again by their place.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = cut_lineage(lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes")), "csv-quotes")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    starts = counts.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    known = cut_lineage(starts, "csv-starts")
    if known.count() <= BROADCAST_BLOCKS:
        marked = lines.join(F.broadcast(known), ["file", "block"])
    else:
        placed = lines.withColumn("place", F.monotonically_increasing_id()).join(known, ["file", "block"])
        marked = placed.repartition("file", "block").sortWithinPartitions("file", "block", "place").drop("place")

    names = ["file", "block", "line", "value", "open_start", "open_end"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, first, inside, number, out = None, [], False, False, 0, []

        def flush(open_end: bool) -> None:
            if held:
                out.append((*here, number, "\n".join(held), first, open_end))
                held.clear()

        for batch in batches:
            for value, file, block, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block", "inside"))):
                if (file, block) != here:
                    flush(inside)
                    here, first, inside, number = (file, block), start, start, 0
                held.append(value)
                inside ^= value.count('"') % 2 == 1
                if not inside:
                    flush(False)
                    first, number = False, number + 1
                if len(out) >= _BATCH:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out.clear()
        flush(inside)
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    schema = "file string, block long, line long, value string, open_start boolean, open_end boolean"
    parts = marked.mapInArrow(cut, schema)
    parts = cut_lineage(parts, "csv-parts")
    whole = parts.where("not open_start and not open_end").select("file", "block", "line", "value")
    # a record over several blocks belongs to the block where it starts; at most two pieces a block get here
    pieces = parts.where("open_start or open_end")
    upto = Window.partitionBy("file").orderBy("block", "line").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.struct("block", "line")
    pieces = pieces.withColumn("begun", F.last(F.when(~F.col("open_start"), begun), True).over(upto))
    joined = pieces.groupBy("file", "begun").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("all"))
    joined = joined.select("file", "begun.block", "begun.line", F.array_join("all.value", "\n").alias("value"))
    records = whole.unionByName(joined).withColumn("value", F.regexp_replace("value", "\r$", ""))
    if header:
        records = records.where((F.col("block") > 0) | (F.col("line") > 0))
    return records.where("value <> ''")
