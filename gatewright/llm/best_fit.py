"""Packing of whole documents into as few sequences as possible by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.encode import default_vocabulary, encoder
from gatewright.llm.texts import as_bytes, pieces
from gatewright.session import cut_lineage, spread

LENGTH = 1024
END_ID = 2
#: Pieces that are packed together: a bounded task, with about as much padding as one of all pieces.
GROUP_PIECES = 32_768

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def place(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each item of 1 to ``length`` tokens, in the order given.

    ``open_`` counts the open sequences of each residual gap. An item goes to a gap with room for it such that the sum of the squares
    of these counts becomes smallest; of equal ones to the smallest gap; to a new sequence if no open one has room. A full
    sequence is no longer open. Longest items first leave the least padding.
    """
    open_ = np.zeros(length + 1, np.int64)
    held: list[list[int]] = [[] for _ in range(length + 1)]
    sequence, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(open_[n:length]) + n
        if len(gaps):
            # (open - 1)^2 - open^2 for the gap that goes, (open + 1)^2 - open^2 for the one that comes
            change = 1 - 2 * open_[gaps] + np.where(gaps > n, 2 * open_[gaps - n] + 1, 0)
            gap = int(gaps[np.argmin(change)])
            at = held[gap].pop()
            open_[gap] -= 1
        else:
            gap, at, used = length, used, used + 1
        sequence[i], offset[i] = at, length - gap
        if gap > n:
            held[gap - n].append(at)
            open_[gap - n] += 1
    return sequence, offset


def cut(docs: DataFrame, id_column: str, text_column: str, length: int, end_id: int, vocabulary: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of a document's ids; all but the first have ``length`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in pieces(batches, "text"):
            out = []
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode.ids(body.decode("utf-8", "replace")), np.uint32(end_id))
                edges = [0, *range((len(ids) - 1) % length + 1, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    out.append((doc, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4", copy=False).tobytes())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), as_bytes(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids and a final ``end_id``; null and empty texts are that id alone. Only documents of more than ``length`` ids
    are cut, into pieces of ``length``; their first piece may be shorter. Pieces of ``length`` are sequences of their own (negative
    numbers); all others are placed by :func:`place`, longest first, in groups of about ``group_pieces`` dealt by a hash of the
    row's number. Null ids and repeated rows are documents like any other, repeated ones not in one group. An empty table has no
    pieces. Other columns are not read. ``sequence_id`` is unique over the whole table, not dense.

    Scale: texts are encoded once; what is written and shuffled has some 50 bytes a document, no ids.
    """
    found = cut(docs, id_column, text_column, length, end_id, vocabulary or default_vocabulary())
    found = cut_lineage(found.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = found.where(F.col("length") == length)
    rest = found.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group_pieces))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("uid", "ascending")])
        sequence, offset = place(table.column("length").to_numpy(), length)
        sequence += table.column("grp")[0].as_py() << 32
        table = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        return table.select([c.split()[0] for c in PIECES.split(", ")])

    dealt = spread(rest.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("long")), "grp")
    packed = dealt.groupBy("grp").applyInArrow(fill, PIECES)
    alone = whole.withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone.drop("uid"))
