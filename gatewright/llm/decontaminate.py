"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item that occurs in a text with at most k edits, cut into k + 1 pieces, leaves one piece untouched. So texts are
searched for exact hits of pieces (by the first bytes of each place). Halving the pieces again and again, some half of c pieces
always has fewer than c edits, so a hit is followed only while its runs of 2, 4, ... pieces stay below that. Hits on nearly the
same diagonal then become one window. Myers' bit-parallel distance decides, for the runs and for the whole item.

Items and texts are compared with A-Z in lower case and white space runs as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.texts import SPACE, U64, as_bytes, buffer_of, pieces

#: Bytes of a piece that are looked up at every place of a text: the most that all pieces of its item have.
HEADS = (8, 5, 3)
HEAD = HEADS[0]
BITS = 20
ERROR_RATE = 0.1
BLOCK_BYTES = 4 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[SPACE] = 32


def normal(text: str | None) -> str:
    """One text as it is compared."""
    body = b" ".join((text or "").encode().lower().split())
    return body.decode()


def budget(length: int, rate: float) -> int:
    """Edits allowed for an item of so many code points."""
    return int(length * rate)


def distance_ends(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """Smallest edit distance of the pattern to a substring of the text and where it first ends; None if above k."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


@dataclass
class Index:
    """Pieces of a block of items: for each length of heads, the sorted heads, the pieces of each, and a bitmap of the heads' hashes."""

    items: list[tuple[int, str, int]]  # id, normal text, budget
    tiers: list[tuple]  # (bytes of a head, heads, pieces per head, bitmap)
    short: list[int]  # items searched without pieces

    @classmethod
    def of(cls, items: list[tuple[int, str]], rate: float) -> Index:
        kept, tiers, short = [], {}, []
        for i, (name, text) in enumerate(items):
            k = budget(len(text), rate)
            kept.append((name, text, k))
            cuts = [len(text) * p // (k + 1) for p in range(k + 2)]
            parts = [text[a:b].encode() for a, b in zip(cuts, cuts[1:])]
            size = next((h for h in HEADS if h <= min(map(len, parts))), 0)
            if not size:
                short.append(i)
                continue
            at = np.cumsum([0, *map(len, parts)]).tolist()
            for p, piece in enumerate(parts):
                runs = [_run(parts, at, text[cuts[x] : cuts[y]], p, x, y) for x, y in _halves(p, k + 1)]
                head = int.from_bytes(piece[:size], "little")
                tiers.setdefault(size, {}).setdefault(head, []).append((i, at[p], piece, runs))
        out = []
        for size, by_head in tiers.items():
            heads = np.array(sorted(by_head), U64)
            seen = np.zeros(1 << BITS, bool)
            seen[_slot(heads)] = True
            out.append((size, heads, [by_head[int(h)] for h in heads], seen))
        return cls(kept, out, short)


def _run(parts: list[bytes], at: list[int], text: str, p: int, x: int, y: int) -> tuple:
    """(byte offset, text, its bytes, edits, near, far) of a run of the pieces x to y that holds the piece p. ``near`` and ``far``, for two pieces:
    byte offset and bytes of the halves of the other piece; with a single edit, near stays in its place or far is within 4 bytes of it."""
    near = far = None
    if y - x == 2:
        other = parts[x + y - 1 - p]
        cut = len(other) // 2
        while other[cut] & 0xC0 == 0x80:
            cut -= 1
        ends = (at[x + y - 1 - p], other[:cut]), (at[x + y - 1 - p] + cut, other[cut:])
        near, far = ends if x == p else ends[::-1]
    return at[x], text, at[y] - at[x], y - x - 1, near, far


def _may_hold(raw: bytes, origin: int, start: int, end: int, run: tuple) -> bool:
    """Whether the run can be at its place; ``origin``: where the item would begin."""
    offset, text, size, k, near, far = run
    if near:
        if raw.startswith(near[1], max(0, origin + near[0])) and origin + near[0] >= start:
            return True
        place = origin + far[0]
        return raw.find(far[1], max(start, place - 4), min(end, place + len(far[1]) + 4)) >= 0
    return distance_ends(text, _window(raw, start, end, origin + offset, size, k)[1], k) is not None


def _halves(piece: int, n: int) -> list[tuple[int, int]]:
    """The runs of pieces that hold the given one, smallest first, without the piece and the whole."""
    low, high, out = 0, n, []
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if piece < middle else (middle, high)
        out.append((low, high))
    return [r for r in reversed(out) if r[1] - r[0] > 1]


def _slot(heads: np.ndarray) -> np.ndarray:
    return (heads * U64(0x9E3779B97F4A7C15) >> U64(64 - BITS)).astype(np.int64)


def _folded(texts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts in the compared form, each followed by 16 zero bytes, and where each starts."""
    data, at = buffer_of(texts)
    low = _FOLD[data]
    blank = low == 32
    first = np.zeros(len(low) + 1, bool)
    first[at] = True
    drop = blank & (np.r_[True, blank[:-1]] | first[:-1])
    keep = ~drop
    n = np.add.reduceat(np.r_[keep, False].astype(np.int64), np.minimum(at[:-1], len(low))) if len(at) > 1 else np.zeros(0, np.int64)
    n[at[1:] == at[:-1]] = 0
    starts = np.cumsum(n + 16) - n - 16
    out = np.zeros(int((n + 16).sum()), np.uint8)
    kept = low[keep]
    out[np.arange(len(kept)) + np.repeat(starts - (np.cumsum(n) - n), n)] = kept
    return out, np.r_[starts, len(out)]


def search(texts: pa.BinaryArray, index: Index) -> list[tuple[int, int, int, int]]:
    """(row, item, distance, end in code points of the compared text) of each item found in each text."""
    data, starts = _folded(texts)
    found, raw = [], data.tobytes()
    diagonals: dict[tuple[int, int], list[int]] = {}
    for size, heads, owner, seen in index.tiers:
        if len(data) <= HEAD:
            continue
        # the first bytes at each place as one number
        head = data[:-7].astype(U64)
        for i in range(1, size):
            head |= data[i : len(data) - 7 + i].astype(U64) << U64(8 * i)
        at = np.flatnonzero(seen[_slot(head)])
        which = np.minimum(np.searchsorted(heads, head[at]), len(heads) - 1)
        exact = heads[which] == head[at]
        at, which = at[exact], which[exact]
        rows = np.searchsorted(starts, at, "right") - 1
        for place, w, row in zip(at.tolist(), which.tolist(), rows.tolist()):
            start, end = int(starts[row]), int(starts[row + 1]) - 16
            for item, offset, piece, runs in owner[w]:
                if raw.startswith(piece, place) and all(_may_hold(raw, place - offset, start, end, run) for run in runs):
                    diagonals.setdefault((row, item), []).append(place - offset)
    for (row, item), shifts in diagonals.items():
        best = _best(raw, int(starts[row]), int(starts[row + 1]) - 16, index.items[item], sorted(set(shifts)))
        if best:
            found.append((row, item, *best))
    for item in index.short:
        _, text, k = index.items[item]
        body = text.encode()
        for row in range(len(starts) - 1) if body else []:
            start, end = int(starts[row]), int(starts[row + 1]) - 16
            if k:
                got = distance_ends(text, raw[start:end].decode(), k)
                found += [(row, item, *got)] if got else []
            elif (place := raw.find(body, start, end)) >= 0:
                found.append((row, item, 0, len(raw[start:place].decode()) + len(text)))
    return found


def _window(raw: bytes, start: int, end: int, at: int, size: int, k: int) -> tuple[int, str]:
    """Where a window begins that holds all that k edits can move, and its code points."""
    a, b = max(start, at - 4 * k), min(end, at + size + 8 * k)
    while a > start and raw[a] & 0xC0 == 0x80:
        a -= 1
    while b < end and raw[b] & 0xC0 == 0x80:
        b += 1
    return a, raw[a:b].decode()


def _best(raw: bytes, start: int, end: int, item: tuple[int, str, int], shifts: list[int]) -> tuple[int, int] | None:
    """The least distance over windows around the diagonals; diagonals less than 2k apart share a window."""
    _, text, k = item
    wide, best, i = 4 * k, None, 0  # k code points are at most 4k bytes
    size = len(text.encode())
    while i < len(shifts):
        j = i
        while j + 1 < len(shifts) and shifts[j + 1] - shifts[j] <= 2 * wide:
            j += 1
        a, window = _window(raw, start, end, shifts[i], size + shifts[j] - shifts[i], k)
        got = distance_ends(text, window, k)
        if got and (best is None or got[0] < best[0]):
            best = (got[0], len(raw[start:a].decode()) + got[1])
            if not got[0]:
                break
        i = j + 1
    return best


def blocks_of(benchmark: DataFrame, item_column: str, text_column: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, so that no task holds more than one block. Blank items and null texts are no items."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(text_column).alias("text"))
    for row in rows.where(F.col("text").isNotNull()).distinct().orderBy("item", "text").toLocalIterator():
        text = normal(row.text)
        if text:
            block.append((row.item, text))
            size += len(text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    rate: float = ERROR_RATE,
) -> DataFrame:
    """(doc_id, item_id, distance, end_char): a row per document row and benchmark item that it holds with at most
    ``budget`` edits (a tenth of the item's code points).

    ``distance`` is the smallest one of the item in the text, ``end_char`` where that occurrence ends in the compared form.
    Items under ten code points must occur exactly. Null and empty texts hold nothing; null and blank items match nothing; null
    ids and repeated rows stay as they are. Equal items are reported each. Empty tables give an empty result.

    Scale: the benchmark is a stated query set, held against all rows in blocks of 4 MB of item text; texts are not shuffled.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), as_bytes(text_column).alias("text"))
    kinds = "doc_id long, item_id long, distance long, end_char long"
    out = None
    for block in blocks_of(benchmark, item_column, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = Index.of(block, rate)
            for batch in pieces(batches, "text"):
                got = search(batch.column("text"), index)
                ids = batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.record_batch(
                    [ids, *(pa.array(c, pa.int64()) for c in (
                        [index.items[g[1]][0] for g in got], [g[2] for g in got], [g[3] for g in got]))],
                    names=["doc_id", "item_id", "distance", "end_char"],
                )

        hits = rows.mapInArrow(run, kinds)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else docs.sparkSession.createDataFrame([], kinds)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; all columns stay. Rows are judged by their text, not their id."""
    out = docs
    for block in blocks_of(benchmark, "item_id", "text"):
        out = out.where(_clean(block, rate)(as_bytes(text_column)))
    return out


def _clean(block: list[tuple[int, str]], rate: float):
    """A column function of texts: whether they hold none of the items."""

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index.of(block, rate)
        for texts in batches:
            ok, at = np.ones(len(texts), bool), 0
            for part in pieces([pa.record_batch([texts], names=["text"])], "text"):
                ok[[at + g[0] for g in search(part.column("text"), index)]] = False
                at += part.num_rows
            yield pa.array(ok)

    return clean
