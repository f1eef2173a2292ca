"""Repeated passages by relative Lempel-Ziv parsing against blocks of all earlier documents.

Every window of ``window`` words has an anchor: the run of ``gram`` words in it whose hash is smallest. The windows of one
anchor follow each other; the words they cover are the anchor's block. All blocks of all documents are the reference, keyed
by hashes of anchor and block.

Parsing a document copies greedily: if a block's smallest document is an earlier one, the whole block is one factor. Where
the anchor is known from an earlier document but the block is not (a passage begins or ends inside it), the factor's boundary
is checked window by window against the windows of the other blocks of that anchor. Factors are at least one window long, so
the words they cover are exactly the words of windows that also start in a document with a smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.texts import U64, Words, as_bytes, mix, pieces, signed, words_of
from gatewright.session import cut_lineage

NO_ID = -(1 << 63)


def slide(values: np.ndarray, op: np.ufunc, n: int) -> np.ndarray:
    """op over each n values in a row."""
    width = 1
    while 2 * width <= n:
        values, width = op(values[:-width], values[width:]), 2 * width
    rest = n - width
    return op(values[: len(values) - rest], values[rest:]) if rest else values


class Anchors:
    """Anchors of the texts of a slice: ``key``; the windows [low, high] it stands for; hash ``block`` of what they cover."""

    def __init__(self, words: Words, window: int, gram: int):
        self.words, self.window = words, window
        n, span = len(words.start), window - gram + 1
        self.text = np.repeat(np.arange(len(words.first) - 1), words.counts)
        self.runs = words.runs()
        empty = np.zeros(0, np.int64)
        self.at = self.low = self.high = empty
        self.key = self.block = np.zeros(0, U64)
        if n < window:
            return
        i = np.arange(n - gram + 1)
        grams = self.runs.hash(i, i + gram)
        start = np.arange(n - window + 1)
        start = start[start + window <= words.first[1:][self.text[start]]]
        if not len(start):
            return
        least = slide(grams, np.minimum, span)[start]
        # the first gram with that hash at or after the window's start
        values, rank = np.unique(grams, return_inverse=True)
        order = np.sort(rank * (n + 1) + i)
        place = order[np.searchsorted(order, np.searchsorted(values, least) * (n + 1) + start)] % (n + 1)
        head = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(start) != 1)])
        self.at, self.low = place[head], start[head]
        self.high = start[np.r_[head[1:], len(start)] - 1]
        self.key = grams[self.at]
        before = (self.at - self.low).astype(U64)
        self.block = mix(self.runs.hash(self.low, self.high + window) + before * U64(0x9FB21C651E98DF25))

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen anchors: number of the anchor, start of each of its windows, the windows' hashes."""
        n = self.high[chosen] - self.low[chosen] + 1
        owner = np.repeat(chosen, n)
        start = self.low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return owner, start, self.runs.hash(start, start + self.window)


def _doc_of(batch: pa.RecordBatch, anchors: Anchors, places: np.ndarray) -> np.ndarray:
    return batch.column("id").to_numpy()[anchors.text[places]]


def repeated_words(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 50, gram: int = 24
) -> DataFrame:
    """(id, text as bytes, spans): the word spans of each document that earlier documents hold; null where none.

    ``spans`` is an array of (start, end) word numbers in order, disjoint. Rows of the same id are one document: they do
    not repeat each other. A null id counts as smaller than all ids. Null, empty and short texts have no window.

    Scale: hashes of about two runs in (window - gram) words go through the shuffle, no text; hot anchors and blocks meet in
    ``min``/``max`` aggregates combined before the shuffle and in joins AQE can split. Texts are shuffled by id (one exchange,
    read twice): once for the windows at factor boundaries, once for the spans.
    """
    rows = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), as_bytes(text_column).alias("text")
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = Anchors(words_of(batch.column("text")), window, gram)
            yield pa.record_batch(
                [pa.array(signed(found.key)), pa.array(signed(found.block)), pa.array(_doc_of(batch, found, found.at))],
                names=["key", "block", "id"],
            )

    blocks = rows.mapInArrow(index, "key long, block long, id long")
    # anchors in two documents or more; all others are literals. Join sides that come out of an aggregate are written first:
    # a join straight above an aggregate is one that AQE can neither broadcast by size nor split at a hot anchor
    keys = blocks.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key")
    known = cut_lineage(blocks.join(cut_lineage(keys, "repeated-anchors"), "key", "left_semi"), "known-blocks")
    first = cut_lineage(known.groupBy("key", "block").agg(F.min("id").alias("first")), "first-blocks")
    several = first.groupBy("key").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x < y").select("key")
    first = first.join(cut_lineage(several, "split-anchors").withColumn("several", F.lit(True)), "key", "left")
    # what each document has to look at: blocks that earlier documents hold, and blocks to check by window
    marks = known.join(first, ["key", "block"]).select(
        "id", "key", "block", (F.col("first") < F.col("id")).alias("whole"), F.coalesce("several", F.lit(False)).alias("several")
    )
    # repeats go in the sets below: a distinct here would use the join's own partitioning, and AQE could not split it
    marks = cut_lineage(marks.where("whole or several"), "marks")
    checks = marks.where("not whole").groupBy("id").agg(F.collect_set(F.struct("key", "block")).alias("found"))

    def boundary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            batch = batch.filter(batch.column("found").is_valid())
            if not batch.num_rows:
                continue
            here = Anchors(words_of(batch.column("text")), window, gram)
            owner, start, hashes = here.windows(_marked(batch, here, "found"))
            one = np.unique(mix(hashes ^ mix(here.key[owner] + here.text[start].astype(U64))), return_index=True)[1]
            owner, start, hashes = owner[one], start[one], hashes[one]
            yield pa.record_batch(
                [pa.array(signed(here.key[owner])), pa.array(signed(hashes)), pa.array(_doc_of(batch, here, start))],
                names=["key", "hash", "id"],
            )

    windows = rows.join(checks, "id", "left").mapInArrow(boundary, "key long, hash long, id long")
    windows = cut_lineage(windows, "boundary-windows")
    held = windows.groupBy("key", "hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    late = windows.join(cut_lineage(held, "repeated-windows"), ["key", "hash"]).where("id > first").select("id", "key", "hash")
    found = (
        marks.where("whole").select("id", "key", F.col("block").alias("hash"), F.lit(True).alias("whole"))
        .unionByName(late.withColumn("whole", F.lit(False)))
        .groupBy("id")
        .agg(
            F.collect_set(F.when(F.col("whole"), F.struct("key", F.col("hash").alias("block")))).alias("found"),
            F.collect_set(F.when(~F.col("whole"), F.struct("key", F.col("hash").alias("block")))).alias("late"),
        )
    )

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            here = Anchors(words_of(batch.column("text")), window, gram)
            whole = _marked(batch, here, "found")
            owner, start, hashes = here.windows(np.arange(len(here.at)))
            one = _marked_pairs(batch, "late", here.text[here.at][owner], here.key[owner], hashes)
            cover = np.zeros(len(here.words.start) + 1, np.int64)
            np.add.at(cover, here.low[whole], 1)
            np.add.at(cover, here.high[whole] + window, -1)
            np.add.at(cover, start[one], 1)
            np.add.at(cover, start[one] + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            out = []
            for a, b in zip(here.words.first[:-1], here.words.first[1:]):
                edge = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False]))
                out.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)] or None)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([batch.column("id"), batch.column("text"), pa.array(out, kind)], names=["id", "text", "spans"])

    return rows.join(found, "id", "left").mapInArrow(spans, "id long, text binary, spans array<struct<start:long,end:long>>")


def _marked(batch: pa.RecordBatch, here: Anchors, column: str) -> np.ndarray:
    """Numbers of the anchors whose key and block are in the row's list."""
    return _marked_pairs(batch, column, here.text[here.at], here.key, here.block)


def _marked_pairs(batch: pa.RecordBatch, column: str, text: np.ndarray, key: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the (text, key, hash) that are in the list of the text's row."""
    lists = batch.column(column)
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    if not len(flat) or not len(text):
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lists)), counts).astype(U64)

    def one(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a ^ mix(b + mix(rows.astype(U64))))

    have = one(row, flat.field("key").to_numpy().view(U64), flat.field("block").to_numpy().view(U64))
    return np.flatnonzero(np.isin(one(text, key, hashes), have))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 50, gram: int = 24) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) per row of ``docs``, without the repeated words.

    Null ids come back as null; see :func:`repeated_words` for ties, nulls and short texts. Kept words are joined by one space.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for i, text, spans in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "spans"))):
                words, kept, last = text.split(), [], 0
                for s in spans or []:
                    kept += words[last : s["start"]]
                    last = s["end"]
                kept = kept + words[last:] if last else words
                body = b" ".join(kept)
                out.append((None if i == NO_ID else i, len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), body))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "body"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    found = repeated_words(docs, id_column, text_column, window, gram).mapInArrow(
        keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, body binary"
    )
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("body").cast("string").alias("kept_text"))
