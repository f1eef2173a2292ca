"""Packing of documents into sequences of equal length, balanced by attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.encode import default_vocabulary, encoder
from gatewright.llm.texts import as_bytes, pieces

LENGTH = 1024
GROUP_DOCS = 4096
END_ID = 0
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n ** 2 (attention stays inside a document).
LINEAR, QUADRATIC = 1.0, 1 / 2048

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def cost(n: np.ndarray | int):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Place items of fewer than ``length`` tokens, given longest first, into as few sequences as their tokens need.

    Each goes to the lowest-cost sequence that has room for all of it. If there is none, it is cut: the sequence with the most
    room takes what fits, then the next. Returns (item, first token of the piece, tokens, sequence, offset).
    """
    count = -(-int(lengths.sum()) // length)
    room, load, out = np.full(count, length, np.int64), np.zeros(count), []
    for item, n in enumerate(lengths.tolist()):
        done = 0
        while done < n:
            rest = n - done
            fits = np.flatnonzero(room >= rest)
            at = int(fits[np.argmin(load[fits])]) if len(fits) else int(np.argmax(room))
            take = min(rest, int(room[at]))
            out.append((item, done, take, at, length - int(room[at])))
            room[at] -= take
            load[at] += cost(take)
            done += take
    return out


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    vocabulary: str | None = None,
    group_docs: int = GROUP_DOCS,
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids and a final ``END_ID``; null and empty texts are that id alone. Whole lengths of a document are
    sequences of their own; the rests are packed in groups of about ``group_docs`` documents, dealt by a hash of the row's number,
    with one partly filled sequence's worth of padding per group. Null ids and repeated rows are documents like any other, repeated
    ones not in one group. ``docs`` is read from files, so that a row has the same number if its task runs again.
    An empty table has no pieces. ``sequence_id`` is unique over the whole table, not dense.

    Scale: ids of rests only (under ``length`` per document) are shuffled, texts are not; a group is a bounded task.
    """
    path = vocabulary or default_vocabulary()
    groups = max(1, -(-docs.count() // group_docs))
    ident, text = F.col(id_column).cast("long"), as_bytes(text_column)
    number = F.xxhash64(F.monotonically_increasing_id())
    rows = docs.select(ident.alias("doc_id"), text.alias("text"), F.pmod(number, F.lit(groups)).cast("int").alias("grp"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in pieces(batches, "text"):
            out = []
            for grp, doc, body in zip(*(batch.column(c).to_pylist() for c in ("grp", "doc_id", "text"))):
                ids = np.append(encode.ids(body.decode("utf-8", "replace")), np.uint32(END_ID))
                for at in range(0, len(ids), length):
                    part = ids[at : at + length].tobytes()
                    whole = len(part) == 4 * length
                    out.append((grp, doc, at, len(part) // 4, len(ids), zlib.crc32(part), None if whole else part))
            kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
            names = ["grp", "doc_id", "start", "length", "doc_tokens", "crc", "ids"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def fill(table: pa.Table) -> pa.Table:
        doc, start, size, total, crc, ids = (
            table.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "crc", "ids")
        )
        base = table.column("grp")[0].as_py() << 32
        whole = sorted((i for i in range(len(doc)) if ids[i] is None), key=lambda i: (doc[i] is None, doc[i], start[i], crc[i]))
        rest = sorted((i for i in range(len(doc)) if ids[i] is not None), key=lambda i: (-size[i], doc[i] is None, doc[i], ids[i]))
        out = [(doc[i], start[i], size[i], crc[i], total[i], base + s, 0) for s, i in enumerate(whole)]
        base += len(whole)
        for item, first, n, sequence, offset in assign(np.array([size[i] for i in rest], np.int64), length):
            i = rest[item]
            part = zlib.crc32(ids[i][4 * first : 4 * (first + n)])
            out.append((doc[i], start[i] + first, n, part, total[i], base + sequence, offset))
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    cuts = "grp int, doc_id long, start long, length long, doc_tokens long, crc long, ids binary"
    return rows.mapInArrow(cut, cuts).groupBy("grp").applyInArrow(fill, PIECES)
