"""Texts as NumPy arrays inside Arrow tasks: slices of bounded size, words, hashes of words and of runs of words.

Texts travel as UTF-8 bytes (``binary``): no decoding, and a batch is one buffer with offsets. White space is the six
ASCII characters ``\\t \\n \\v \\f \\r`` and space, in every operator of this subpackage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
U64 = np.uint64
_LANE = U64(0x9E3779B97F4A7C15)
#: Longer words are hashed one by one.
VECTOR_BYTES = 64
_WORD_BASE = U64(0xD1342543DE82EF95)


def as_bytes(name: str) -> Column:
    """A text column as bytes; null is the empty text."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices that hold at most ``most`` text bytes, or one row."""
    for batch in batches:
        sizes = np.diff(offsets_of(batch.column(column)))
        if not len(sizes):
            continue
        share = (np.cumsum(sizes) - sizes) // most
        for at in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(share)) + 1):
            yield batch.slice(int(at[0]), len(at))


def offsets_of(texts: pa.BinaryArray) -> np.ndarray:
    """Where each text starts in the array's buffer, and where the last ends."""
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def buffer_of(texts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts, and the offsets of each text among them."""
    at = offsets_of(texts)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    out = np.full(n + 1, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    return U64(pow(int(base), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of sums of products over the whole word."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


class Runs:
    """Hashes of runs of a sequence by prefix sums: of values [start, end), wherever the run stands."""

    def __init__(self, values: np.ndarray, base: np.uint64):
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * powers(base, max(len(values) - 1, 0))[: len(values)], out=self.sums[1:])
        self.back = powers(inverse(base), len(values))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = (end - start).astype(U64)
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + n * U64(0x2545F4914F6CDD1D))


@dataclass
class Words:
    """Words of many texts: byte places of each, and the number of the first word of each text (and the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, eight bytes after another. A polynomial of the bytes modulo 2 ** 64 would not do: there are texts of
        a thousand bytes that have the same one for every odd base."""
        size = self.end - self.start
        out = size.astype(U64) * _LANE
        padded = np.r_[self.data, np.zeros(8, np.uint8)]
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        now = np.flatnonzero(size <= VECTOR_BYTES)
        for at in range(0, VECTOR_BYTES, 8):
            now = now[size[now] > at]
            if not len(now):
                break
            held = np.minimum(size[now] - at, 8).astype(U64)
            lane = eight[self.start[now] + at] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * held))
            out[now] = mix((out[now] ^ lane) * _LANE + U64(1))
        for i in np.flatnonzero(size > VECTOR_BYTES).tolist():
            out[i] = xxhash.xxh64_intdigest(self.data[self.start[i] : self.end[i]].tobytes())
        return out

    def runs(self) -> Runs:
        """Hashes of runs of words."""
        return Runs(self.hashes(), _WORD_BASE)


def words_of(texts: pa.BinaryArray) -> Words:
    """Split texts at white space."""
    data, at = buffer_of(texts)
    inside = ~SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, at))


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's long."""
    return np.ascontiguousarray(h).view(np.int64)
