"""Hard negatives: the rows of another label that score just below an anchor's positives, by exact integer products of tiles.

Rows and anchors are dealt into blocks; each pair of blocks meets in a task of its own, which multiplies their tiles by
Strassen's recursion on 64-bit integers and returns each anchor's best few. Such heaps are merged by rank. A first pass finds the
positives, whose scores are the windows that the second one fills.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.session import cut_lineage, spread

#: Rows and anchors in a block: two blocks with 64 components are 4 MB.
BLOCK_ROWS = 4096
#: Anchors that are scored at once within a task.
TILE_ROWS = 256
#: Tiles of no more rows, columns or components are multiplied as they are.
LEAST = 8
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``a @ b`` of int64 matrices by seven products of halves; odd sizes are padded with a row or column of zeros.

    Additions and products are exact modulo 2 ** 64, so the result is exact wherever it fits 64 bits, whatever the sums on the way.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= least:
        return a @ b
    if (m | k | n) & 1:
        a = np.pad(a, ((0, m & 1), (0, k & 1)))
        b = np.pad(b, ((0, k & 1), (0, n & 1)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, least)
    p2 = strassen(a21 + a22, b11, least)
    p3 = strassen(a11, b12 - b22, least)
    p4 = strassen(a22, b21 - b11, least)
    p5 = strassen(a11 + a12, b22, least)
    p6 = strassen(a21 - a11, b11 + b12, least)
    p7 = strassen(a12 - a22, b21 + b22, least)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def best(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``most`` largest allowed scores of each row, of equal ones those of the first columns."""
    scores = np.where(allowed, scores, NONE)
    if scores.shape[1] > most:
        edge = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
        allowed = allowed & (scores >= edge[:, None])
    row, column = np.nonzero(allowed)
    # equal scores stay in the order of their columns
    order = np.lexsort((column, ~scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < most
    return row[kept], column[kept]


def lowest(score: np.ndarray, percent: int) -> np.ndarray:
    """The least s with 100 * s >= percent * score, without a product that could overflow."""
    q, r = np.divmod(score, 100)
    return percent * q - (-percent * r) // 100


def highest(score: np.ndarray, percent: int) -> np.ndarray:
    """The largest s with 100 * s <= percent * score."""
    q, r = np.divmod(score, 100)
    return percent * q + (percent * r) // 100


# --- blocks -----------------------------------------------------------------------------------------------------------

BLOCK = "block long, n long, ids binary, uids binary, labels binary, vectors binary, windows binary"


def blocks_of(rows: DataFrame, blocks: int, width: int, windows: int = 0) -> DataFrame:
    """Rows (uid, id, label, vector and, if ``windows``, scores) as blocks, rows ascending by id; vectors end in zeros up to ``width``."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("uid", "ascending")])

        def matrix(name: str, columns: int, empty: int) -> bytes:
            lists = table.column(name).combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            out = np.full((len(lists), columns), empty, np.int64)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out[np.repeat(np.arange(len(lists)), sizes), place] = lists.flatten().to_numpy()
            return out.tobytes()

        cells = [table.column("block")[0].as_py(), len(table)]
        cells += [table.column(c).to_numpy().tobytes() for c in ("id", "uid", "label")]
        cells += [matrix("vector", width, 0), matrix("scores", windows, NONE) if windows else b""]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.table([pa.array([c], k) for c, k in zip(cells, kinds)], names=[c.split()[0] for c in BLOCK.split(", ")])

    number = F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("long")
    return rows.withColumn("block", number).groupBy("block").applyInArrow(pack, BLOCK)


class Block:
    """A block's arrays inside a task."""

    def __init__(self, table: pa.Table):
        cell = {name: table.column(name)[0].as_py() for name in table.column_names}
        self.ids, self.uids, self.labels = (np.frombuffer(cell[c], np.int64) for c in ("ids", "uids", "labels"))
        self.vectors = np.frombuffer(cell["vectors"], np.int64).reshape(cell["n"], -1)
        self.windows = np.frombuffer(cell["windows"], np.int64).reshape(cell["n"], -1)


def tiles(anchors: Block, rows: Block):
    """(slice of anchors, scores of all rows) of a pair of blocks."""
    turned = np.ascontiguousarray(rows.vectors.T)
    for at in range(0, len(anchors.ids), TILE_ROWS):
        part = slice(at, at + TILE_ROWS)
        yield part, strassen(anchors.vectors[part], turned)


def meet(anchors: DataFrame, anchor_blocks: int, rows: DataFrame, row_blocks: int, score, schema: str) -> DataFrame:
    """``score`` of each pair of an anchor block and a row block, each pair a group of its own."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = spread(anchors.withColumn("other", every(row_blocks)), "block", "other")
    right = spread(rows.withColumnRenamed("block", "other").withColumn("block", every(anchor_blocks)), "block", "other")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in schema.split(", ")]
        found = score(Block(a), Block(b)) if len(a) and len(b) else [np.zeros(0, np.int64)] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=names)

    return left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInArrow(run, schema)


# --- the search -------------------------------------------------------------------------------------------------------


def mine(
    rows: DataFrame,
    is_anchor: Column,
    id_column: str = "vec_id",
    vector_column: str = "vector",
    label_column: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for integer vectors (array<long>).

    A score is the inner product with the anchor; higher ones come first, ties by smaller id. Of an anchor's ``positives`` best other
    rows of its label, each gets the ``negatives`` best rows of other labels with ``low * p <= 100 * s <= high * p`` for its own
    score p: none, then, if p is negative.

    Rows with a null id, label, vector or component take no part. Vectors of unequal length end in zeros. Scores must fit 64 bits.
    Rows of equal id are rows of their own: each other's positives if their label is the same, and anchors each. An empty table, a
    table without anchors and one of a single label give an empty result. Other columns are not read.

    Scale: every anchor is scored against every row, twice, in tasks of one pair of blocks: ``block_rows`` anchors by
    ``block_rows`` rows, whatever their labels. Rows are shuffled once for each block of anchors, anchors once for each block of rows; each
    pair of blocks returns at most ``positives`` (then ``positives * negatives``) rows an anchor. Nothing is broadcast or collected.
    """
    vector = F.col(vector_column)
    valid = F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    kept = rows.where(valid).select(
        F.col(id_column).cast("long").alias("id"),
        F.col(label_column).cast("long").alias("label"),
        vector.cast("array<long>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    kept = cut_lineage(kept.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    width, count, chosen = kept.agg(F.max(F.size("vector")), F.count("*"), F.count_if("anchor")).first()
    width, row_blocks, anchor_blocks = max(width or 0, 1), max(1, -(-count // block_rows)), max(1, -(-chosen // block_rows))
    table = cut_lineage(blocks_of(kept, row_blocks, width), "vector-blocks")
    anchors = kept.where("anchor").drop("anchor")

    def nearest(a: Block, b: Block) -> list[np.ndarray]:
        out = [[], [], [], []]
        for part, scores in tiles(a, b):
            own = (a.labels[part, None] == b.labels) & (a.uids[part, None] != b.uids)
            i, j = best(scores, own, positives)
            for column, found in zip(out, (a.uids[part][i], b.ids[j], b.uids[j], scores[i, j])):
                column.append(found)
        return [np.concatenate(c) for c in out]

    order = [F.col("score").desc(), "id", "uid"]
    found = meet(blocks_of(anchors, anchor_blocks, width), anchor_blocks, table, row_blocks, nearest, "anchor long, id long, uid long, score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    first = cut_lineage(found.withColumn("place", place).where(F.col("place") <= positives).drop("uid"), "positives")
    windows = F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"])
    windows = first.groupBy(F.col("anchor").alias("uid")).agg(windows.alias("scores"))

    def within(a: Block, b: Block) -> list[np.ndarray]:
        out = [[], [], [], [], []]
        for part, scores in tiles(a, b):
            other = a.labels[part, None] != b.labels
            for k in range(positives):
                p = a.windows[part, k, None]
                open_ = p != NONE
                held = other & open_ & (scores >= lowest(np.where(open_, p, 0), low)) & (scores <= highest(np.where(open_, p, 0), high))
                i, j = best(scores, held, negatives)
                for column, x in zip(out, (a.uids[part][i], np.full(len(i), k + 1), b.ids[j], b.uids[j], scores[i, j])):
                    column.append(x)
        return [np.concatenate(c) for c in out]

    marked = blocks_of(anchors.join(windows, "uid"), anchor_blocks, width, positives)
    found = meet(marked, anchor_blocks, table, row_blocks, within, "anchor long, place long, id long, uid long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    found = found.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    first = first.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(first, ["anchor", "place"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def scaled(embeddings: DataFrame, factor: int = 256) -> DataFrame:
    """``embeddings`` (vec_id, embedding, label) as (vec_id, label, vector): each component x as floor(factor * x), a null vector if any
    component is null, not finite, or too large for a long; the label of every seventh vec_id moved on by one modulo 10."""
    fits = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double") * factor) < 2.0**63, F.lit(False)))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * factor))
    label = F.col("label").cast("long")
    return embeddings.select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.when(fits, vector).alias("vector"),
    )
