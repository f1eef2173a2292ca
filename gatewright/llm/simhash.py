"""SimHash near-duplicates: fingerprints of word shingles, linked by a vantage-point tree over Hamming distance.

Distinct fingerprints go to the shards of a tree whose vantage points come from a small sample. A fingerprint within the
radius of a sphere's inside edge also goes to the outer shard, so by the triangle inequality each pair within the radius
meets in one shard. A shard is searched by a tree of its own and returns stars, not pairs; components join the stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.components import connected_components
from gatewright.llm.texts import as_bytes, pieces, signed
from gatewright.session import cut_lineage

SEED = 42
SHARD_ROWS = 16_384
SAMPLE_PER_SHARD = 64
LEAF_ROWS = 512
PROBE_ROWS = 200_000


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; of the whole sequence if it has fewer words; none without words."""
    words = text.lower().split()
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = [len(w) + 1 for w in words]
    ends = np.cumsum(sizes)
    starts = (ends[: len(words) - shingle + 1] - sizes[: len(words) - shingle + 1]).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, len(starts))


def simhash(text: bytes, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text: a bit is set if more than half of the shingles' XXH64 have it."""
    hashes = shingle_hashes(text, shingle)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: (id, fp as a signed long). Null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = np.array([simhash(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([batch.column("id"), pa.array(signed(found))], names=["id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), as_bytes(text_column).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


# --- the tree ---------------------------------------------------------------------------------------------------------


def split_at(points: np.ndarray, radius: int, draw: np.random.Generator, tries: int = 6) -> tuple | None:
    """A vantage point and the distance that halves the points best; None if no point parts them."""
    best = None
    for v in draw.choice(points, min(tries, len(points)), replace=False):
        d = np.bitwise_count(points ^ v)
        t = int(np.median(d))
        for cut in (t - 1, t):
            larger = max(int((d <= cut).sum()), int((d > cut - radius).sum()))
            if best is None or larger < best[0]:
                best = (larger, v, cut)
    return best if best and best[0] <= 0.9 * len(points) else None


def grow(points: np.ndarray, radius: int, most: int, draw: np.random.Generator, leaves: list[int]):
    """A tree of nested (vantage point, cut, inner, outer); leaves are numbers."""
    found = split_at(points, radius, draw) if len(points) > most else None
    if found is None:
        leaves.append(len(leaves))
        return leaves[-1]
    _, v, cut = found
    d = np.bitwise_count(points ^ v)
    return (v, cut, grow(points[d <= cut], radius, most, draw, leaves), grow(points[d > cut - radius], radius, most, draw, leaves))


def route(tree, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of the points that belong to it or overlap it from inside)."""
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at
            continue
        v, cut, inner, outer = node
        d = np.bitwise_count(points[at] ^ v)
        stack += [(inner, at[d <= cut]), (outer, at[d > cut - radius])]


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of each link the smaller label, until nothing changes."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        labels[:] = labels[labels]
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]


def shard_labels(points: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct points of a shard, the place of one point of its group."""
    labels, draw = np.arange(len(points)), np.random.default_rng(SEED)
    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        own = points[at]
        found = split_at(own, radius, draw) if len(at) > LEAF_ROWS else None
        if found:
            _, v, cut = found
            d = np.bitwise_count(own ^ v)
            stack += [at[d <= cut], at[d > cut - radius]]
        elif len(at) > PROBE_ROWS and radius <= 2:
            _probe(labels, points, at, radius)
        else:
            for i in range(0, len(at), LEAF_ROWS):
                for j in range(i, len(at), 8 * LEAF_ROWS):
                    x, y = np.nonzero(np.bitwise_count(own[i : i + LEAF_ROWS, None] ^ own[None, j : j + 8 * LEAF_ROWS]) <= radius)
                    new = labels[at[x + i]] != labels[at[y + j]]
                    merge(labels, at[x[new] + i], at[y[new] + j])
    while not np.array_equal(labels, labels[labels]):
        labels = labels[labels]
    return labels


def _probe(labels: np.ndarray, points: np.ndarray, at: np.ndarray, radius: int) -> None:
    """Many points that no sphere parts: look each point's neighbours up instead of comparing all pairs."""
    at = at[np.argsort(points[at])]
    own, bits = points[at], [np.uint64(1) << np.uint64(i) for i in range(64)]
    masks = bits + ([a | b for i, a in enumerate(bits) for b in bits[:i]] if radius == 2 else []) if radius else []
    for mask in masks:
        place = np.minimum(np.searchsorted(own, own ^ mask), len(own) - 1)
        hit = np.flatnonzero(own[place] == own ^ mask)
        merge(labels, at[hit], at[place[hit]])


# --- the join ---------------------------------------------------------------------------------------------------------


def near_links(distinct: DataFrame, rows: int, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Stars (a, b) that connect distinct fingerprints ``fp`` within the radius. ``rows``: how many there are."""
    shards = max(1, rows // shard_rows)
    share = min(1.0, SAMPLE_PER_SHARD * shards / max(rows, 1))
    drawn = distinct.where(F.pmod(F.xxhash64(F.col("fp"), F.lit("sample")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    sample = np.array(sorted(r[0] for r in drawn.select("fp").collect()), np.int64).view(np.uint64)
    leaves: list[int] = []
    tree = grow(sample, radius, max(2, len(sample) // shards), np.random.default_rng(SEED), leaves)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            for shard, at in route(tree, points, radius):
                yield pa.record_batch(
                    [pa.array(np.full(len(at), shard, np.int32)), pa.array(signed(points[at]))], names=["shard", "fp"]
                )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf["fp"].to_numpy().view(np.uint64)
        labels = shard_labels(points, radius)
        at = np.flatnonzero(labels != np.arange(len(labels)))
        return pd.DataFrame({"a": signed(points[at]), "b": signed(points[labels[at]])})

    return distinct.select("fp").mapInArrow(deal, "shard int, fp long").groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id): one row per row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; the component's id is the smallest id reachable. Texts that
    are null, empty or blank have fingerprint zero and link like any other. A null id never names a component unless all
    ids of it are null. Repeated rows stay, each with its result. An empty table gives an empty result. Other columns
    of ``docs`` are not read.

    Scale: texts are read once and never shuffled. The driver sees 64 fingerprints per shard of 16,384; a shard's size
    depends on how finely the tree parts the data, and groups that cannot be parted are searched in blocks.
    """
    rows = cut_lineage(fingerprints(docs, id_column, text_column, shingle), "simhash")
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    links = near_links(distinct, distinct.count(), radius)
    labels = connected_components(links).select(F.col("node").alias("fp"), "label")
    named = distinct.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    final = named.join(least, "label").select("fp", "component_id")
    return rows.join(final, "fp").select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
