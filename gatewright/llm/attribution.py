"""Token counts per section: tokens of the whole document, joined to sections by character spans."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewright.llm.encode import default_vocabulary, encoder
from gatewright.llm.texts import as_bytes, pieces

SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("section", "start", "end")]))
RULES = ("start", "end", "most")


@F.arrow_udf(SPANS)
def line_sections(texts: pa.Array) -> pa.Array:
    """The lines of a text as sections: number, first code point, end; the line break belongs to the line it ends."""
    counts, number, start, end = [0], [], [], []
    for text in texts.to_pylist():
        at = 0
        for i, line in enumerate((text or "").split("\n")):
            number.append(i)
            start.append(at)
            at += len(line) + 1
            end.append(at)
        end[-1] -= 1
        counts.append(len(number))
    kind = [pa.array(x, pa.int64()) for x in (number, start, end)]
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(kind, ["section", "start", "end"]))


def sections_of(docs: DataFrame, sections: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``sections`` gathered from a table (id, section, start, end); none gives null."""
    spans = sections.groupBy(id_column).agg(F.collect_list(F.struct("section", "start", "end")).alias("sections"))
    return docs.join(spans, id_column, "left")


def holders(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, place): from each point to the next, the last of the sections sorted by start that holds it; -1 where none does."""
    if len(start) and (start[1:] >= end[:-1]).all() and (end > start).all():
        # disjoint: a section, then a gap that may be empty
        points = np.stack([start, end], 1).ravel()
        return points, np.stack([np.arange(len(start)), np.full(len(start), -1)], 1).ravel()
    points = np.unique(np.concatenate([start, end]))
    place, open_, i = np.full(len(points), -1), [], 0
    for k, point in enumerate(points.tolist()):
        while i < len(start) and start[i] <= point:
            heapq.heappush(open_, -i)
            i += 1
        while open_ and end[-open_[0]] <= point:
            heapq.heappop(open_)
        if open_:
            place[k] = -open_[0]
    return points, place


def owners(tokens: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> np.ndarray:
    """For each token span the place of its section among sections sorted by start, or -1 if it is in none.

    ``start``: the section that holds the token's first code point; ``end``: its last one; ``most``: the one that holds most of
    it, the earlier of equals. Where sections overlap, the one that starts last counts, as long as it lasts; then those around it
    that still last count again.
    """
    points, place = holders(start, end)

    def part(point: np.ndarray) -> np.ndarray:
        return np.searchsorted(points, point, "right") - 1

    def at(point: np.ndarray) -> np.ndarray:
        return np.where(part(point) >= 0, place[part(point)], -1) if len(points) else np.full(len(point), -1)

    first, last = tokens[:, 0], np.maximum(tokens[:, 1] - 1, tokens[:, 0])
    head, tail = at(first), at(last)
    if rule != "most":
        return head if rule == "start" else tail
    best = head.copy()
    for i in np.flatnonzero(part(first) != part(last)):
        inside = np.array([at(np.array([c]))[0] for c in range(first[i], last[i] + 1)])
        found, where, n = np.unique(inside[inside >= 0], return_index=True, return_counts=True)
        best[i] = found[np.lexsort((where, -n))[0]] if len(found) else -1
    return best


def attribute_tokens(
    docs: DataFrame,
    sections: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    rule: str = "start",
    vocabulary: str | None = None,
) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing): a row per section of each row of ``docs``.

    ``sections`` is an array of (section, start, end) in code points; null and empty arrays are no sections. Each token counts
    for one section by ``rule`` (see :func:`owners`); ``n_crossing`` of them reach beyond it. Tokens of no section make a row
    whose section, start and end are null; so a row's counts add up to its tokens. Sections without tokens have 0. Null and
    empty texts have no tokens. Null ids and repeated rows stay, each with its own rows. Sections of a null start or end are
    left out. Extra columns are not read.

    Scale: nothing is shuffled; the interval join is a merge inside the row, as both sides belong to it.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or default_vocabulary()
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), as_bytes(text_column).alias("text"), sections.cast(SPANS).alias("sections")
    )
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in pieces(batches, "text"):
            parts: list[list] = [[] for _ in names]
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "sections"))):
                tokens = encode.tokens(text.decode("utf-8", "replace"))
                spans = sorted((s for s in spans or [] if s["start"] is not None and s["end"] is not None), key=lambda s: (s["start"], s["end"]))
                start, end = (np.array([s[k] for s in spans], np.int64) for k in ("start", "end"))
                own = owners(tokens, start, end, rule)
                n = np.bincount(own + 1, minlength=len(spans) + 1)
                inside = own >= 0
                beyond = np.zeros(len(own), bool)
                beyond[inside] = (tokens[inside, 0] < start[own[inside]]) | (tokens[inside, 1] > end[own[inside]])
                crossing = np.bincount(own[beyond] + 1, minlength=len(spans) + 1)
                if n[0]:
                    for part, x in zip(parts, (doc, None, None, None, int(n[0]), 0)):
                        part.append(x)
                for part, x in zip(parts, ([doc] * len(spans), [s["section"] for s in spans], start.tolist(), end.tolist(), n[1:].tolist(), crossing[1:].tolist())):
                    part += x
            yield pa.record_batch([pa.array(p, pa.int64()) for p in parts], names=names)

    return rows.mapInArrow(count, ", ".join(f"{n} long" for n in names))
