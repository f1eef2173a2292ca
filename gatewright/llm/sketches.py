"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph ends at a line break or behind ``.``, ``!`` or ``?`` and a space; longer ones are cut every ``MOST`` bytes. Each has a
64-bit digest; the n-th repeat of a paragraph in a text has a digest of its own, so a text is a set. A cell holds the count,
sum of digests and sum of check values of the digests hashed to it, three cells each. The cells of two versions subtract, what
both have cancels, and peeling cells of one digest gives back those that only one version has. If peeling stops early, both
are sketched again with four times the cells.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.texts import U64, Runs, as_bytes, mix, offsets_of

MOST = 256
HASHES = 3
CELLS = 15
GROWTH = 4
BUCKET_ROWS = 8192
MOST_BUCKETS = 4096
SLICE_BYTES = 1 << 19
NO_ID = -(1 << 63)
_BASE = U64(0xA0761D6478BD642F)
_SEEDS = [U64(0xE7037ED1A0B428DB + 0x1000001B3 * i) for i in range(HASHES)]


def paragraphs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of every paragraph of every text, ordered by text and digest."""
    array = pa.array(texts, pa.binary())
    at = offsets_of(array)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    ends = data == 10
    stop = (data == 46) | (data == 33) | (data == 63)
    ends[1:] |= (data[1:] == 32) & stop[:-1]
    edge = np.unique(np.concatenate([np.flatnonzero(ends) + 1, at[1:]]))
    edge = edge[edge > 0]
    start = np.r_[0, edge[:-1]] if len(edge) else edge
    long = -(-(edge - start) // MOST)  # parts of each paragraph
    part = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
    first = np.repeat(start, long) + part * MOST
    last = np.minimum(first + MOST, np.repeat(edge, long))
    digest = Runs(data.astype(U64) + U64(1), _BASE).hash(first, last) if n else np.zeros(0, U64)
    text = np.searchsorted(at, first, "right") - 1
    order = np.lexsort((digest, text))
    text, digest = text[order], digest[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (digest[1:] != digest[:-1])] if len(text) else np.zeros(0, bool)
    repeat = np.arange(len(text)) - np.maximum.accumulate(np.where(new, np.arange(len(text)), 0)) if len(text) else text
    return text, mix(digest + repeat.astype(U64) * U64(0x8EBC6AF09C88C6E3))


class Sketches:
    """The cells of many sketches of one size, as flat arrays."""

    def __init__(self, count: int, cells: int):
        self.share = cells // HASHES
        self.cells = self.share * HASHES
        self.n = np.zeros(count * self.cells, np.int64)
        self.keys = np.zeros(count * self.cells, U64)
        self.checks = np.zeros(count * self.cells, U64)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        signed_keys = np.where(sign > 0, keys, U64(0) - keys)
        check = mix(keys ^ U64(0x589965CC75374CC3))
        signed_checks = np.where(sign > 0, check, U64(0) - check)
        for i, seed in enumerate(_SEEDS):
            at = owner * self.cells + i * self.share + (mix(keys ^ seed) % U64(self.share)).astype(np.int64)
            np.add.at(self.n, at, sign)
            np.add.at(self.keys, at, signed_keys)
            np.add.at(self.checks, at, signed_checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sketch, digest, +1 or -1) of all digests that come free; what is left stays in the cells."""
        owners, keys, signs = [], [], []
        at = np.flatnonzero(np.abs(self.n) == 1)
        while len(at):
            sign = self.n[at]
            key = np.where(sign > 0, self.keys[at], U64(0) - self.keys[at])
            check = np.where(sign > 0, self.checks[at], U64(0) - self.checks[at])
            pure = check == mix(key ^ U64(0x589965CC75374CC3))
            owner, key, sign = (at // self.cells)[pure], key[pure], sign[pure]
            one = np.unique(mix(key + owner.astype(U64) * _BASE), return_index=True)[1]
            owner, key, sign = owner[one], key[one], sign[one]
            if not len(owner):
                break
            self.add(owner, key, -sign)
            owners.append(owner)
            keys.append(key)
            signs.append(sign)
            at = np.flatnonzero(np.abs(self.n) == 1)
        empty = np.zeros(0, np.int64)
        return (
            np.concatenate(owners) if owners else empty,
            np.concatenate(keys) if keys else empty.astype(U64),
            np.concatenate(signs) if signs else empty,
        )

    def left(self) -> np.ndarray:
        """Whether anything is left in each sketch."""
        return ((self.n != 0) | (self.keys != 0) | (self.checks != 0)).reshape(-1, self.cells).any(1)

    def texts(self) -> list[str]:
        """Each sketch in base64: 16 bytes a cell, the low 32 bits of the count and check and the digests' sum."""
        rows = np.empty(len(self.n), [("n", "<i4"), ("check", "<u4"), ("key", "<u8")])
        rows["n"], rows["check"], rows["key"] = self.n, (self.checks & U64(0xFFFFFFFF)), self.keys
        return [base64.b64encode(r.tobytes()).decode() for r in rows.reshape(-1, self.cells)]


def differing(
    count: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, +1 if only in a, -1 if only in b) for ``count`` pairs; ``a``, ``b``: (pair, digest) of either side."""
    out = []
    numbers = np.arange(count)
    na, nb = np.bincount(a[0], minlength=count), np.bincount(b[0], minlength=count)
    todo = numbers[(na + nb) > 0]
    while len(todo):
        # peeling needs more cells than digests, so a size below the difference in numbers is not tried
        can = np.abs(na - nb)[todo] <= cells
        now, later = todo[can], todo[~can]
        place = np.full(count, -1)
        place[now] = np.arange(len(now))
        sketch = Sketches(len(now), cells)
        for (owner, key), sign in ((a, 1), (b, -1)):
            at = place[owner]
            sketch.add(at[at >= 0], key[at >= 0], np.full(int((at >= 0).sum()), sign))
        owner, key, sign = sketch.peel()
        failed = sketch.left()
        good = ~failed[owner]
        out.append((now[owner[good]], key[good], sign[good]))
        todo = np.sort(np.r_[now[failed], later])
        cells *= GROWTH
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, (np.int64, U64, np.int64)[i]) for i in range(3))


def likeness(count: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shared share of all paragraphs of each pair: 1 for equal texts (and two empty ones), 0 if nothing is shared."""
    total = np.bincount(a[0], minlength=count) + np.bincount(b[0], minlength=count)
    d = np.bincount(differing(count, a, b)[0], minlength=count)
    return np.where(total > 0, (total - d) / np.maximum(total + d, 1), 1.0)


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many, or all, of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _bounds(ids: DataFrame) -> list[int]:
    """Ids that part the table into buckets of about ``BUCKET_ROWS`` rows, ``MOST_BUCKETS`` at most."""
    buckets = min(MOST_BUCKETS, ids.count() // BUCKET_ROWS + 1)
    shares = [i / buckets for i in range(1, buckets)]
    return sorted({int(x) for x in ids.approxQuantile("id", shares, 0.25 / buckets)}) if shares else []


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, following) as bytes: each document with the next one in descending id, the last one with the first.

    Ties go by a hash of the text, then the text; null ids stand last, as the smallest id. A table of one row follows itself.

    Scale: one shuffle, into ranges of ids. The first document of a range is also sent to the range before it, so that ranges
    need nothing else from each other; inside, sorted rows stream by.
    """
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), as_bytes(text_column).alias("text"))
    bounds = np.array(_bounds(rows.select("id")), np.int64)

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        # descending: bucket 0 has the largest ids
        return pa.array((len(bounds) - np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False), "left")).astype(np.int32))

    tops = rows.select("id").groupBy(bucket("id").alias("bucket")).agg(F.max("id").alias("top"))
    heads = sorted((r["bucket"], r["top"]) for r in tops.collect())
    before = {top: heads[i - 1][0] for i, (_, top) in enumerate(heads)}
    head_ids = np.array(sorted(before), np.int64)
    targets = np.array([before[int(i)] for i in head_ids], np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "id", "text", "guest"]
        for batch in batches:
            ids, n = batch.column("id").to_numpy(), batch.num_rows
            yield pa.record_batch([*(batch.column(c) for c in names[:3]), pa.array(np.zeros(n, bool))], names=names)
            place = np.minimum(np.searchsorted(head_ids, ids), len(head_ids) - 1)
            at = np.flatnonzero(head_ids[place] == ids)
            if len(at):
                own = [batch.column(c).take(pa.array(at)) for c in names[1:3]]
                yield pa.record_batch([pa.array(targets[place[at]]), *own, pa.array(np.ones(len(at), bool))], names=names)

    dealt = rows.select(bucket("id").alias("bucket"), "id", "text").mapInArrow(deal, "bucket int, id long, text binary, guest boolean")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("id"), F.xxhash64("text"), "text")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, id, text) that waits for the next row

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "text", "following"])

        done, size = [], 0
        for batch in batches:
            for b, i, t, guest in zip(*(batch.column(c) for c in ("bucket", "id", "text", "guest"))):
                b, i, t = b.as_py(), i.as_py(), t.as_py()
                if held and held[0] == b:
                    done.append((held[1], held[2], t))
                    size += len(t)
                held = None if guest.as_py() else (b, i, t)
                if size >= SLICE_BYTES:
                    yield out(done)
                    done, size = [], 0
        if done:
            yield out(done)

    return ordered.mapInArrow(pair, "id long, text binary, following binary")


def fingerprint_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of ``docs``.

    Fingerprints are sketches of ``CELLS`` cells. ``near_*`` is the share of paragraphs in common, found by subtracting sketches
    and peeling, with larger ones where needed. Null and empty texts have the empty sketch. Null ids come back as null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                ids, texts, following = (part.column(c).to_pylist() for c in ("id", "text", "following"))
                n = len(ids)
                points = [t.decode("utf-8", "replace") for t in texts]
                edited = [edited_text(a, b.decode("utf-8", "replace")).encode() for a, b in zip(points, following)]
                sides = [paragraphs(x) for x in (texts, edited, following)]
                prints = []
                for owner, key in sides[:2]:
                    sketch = Sketches(n, CELLS)
                    sketch.add(owner, key, np.ones(len(key), np.int64))
                    prints.append(sketch.texts())
                yield pa.record_batch(
                    [
                        pa.array([None if i == NO_ID else i for i in ids], pa.int64()),
                        pa.array([len(p) for p in points], pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                        *(pa.array(p) for p in prints),
                        pa.array(likeness(n, sides[0], sides[1])),
                        pa.array(likeness(n, sides[0], sides[2])),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return with_next(docs, id_column, text_column).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(np.diff(offsets_of(batch.column("text"))) + np.diff(offsets_of(batch.column("following"))))
    share = sizes // SLICE_BYTES
    for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(share)) + 1):
        if len(at):
            yield batch.slice(int(at[0]), len(at))
