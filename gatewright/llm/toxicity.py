"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of 3 to 5 code points of the lower-cased text (white space as one space, one at either end), hashed to
buckets; a bucket counts once per text. Each is scaled by the log ratio of its smoothed share among toxic and other texts; a
logistic regression is fitted on the scaled features of every bucket that a training text has, and both factors end in one weight
per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.texts import U64, as_bytes, pieces
from gatewright.session import cut_lineage

ORDERS = (3, 4, 5)
BITS = 18
#: Labelled rows to learn from, at most; drawn by a hash of the id.
TRAINING_ROWS = 20_000
SMOOTHING = 1.0
PENALTY = 1e-4
#: The solver ends where no slope is above FLAT, or after MOST_STEPS; it holds the last HELD_STEPS steps.
FLAT, MOST_STEPS, HELD_STEPS = 1e-5, 100, 10
#: Rows that are taken together in a task, and numbers in a piece of its sums on their way through the shuffle.
STEP, PIECE = 256, 8192
HELD_OUT = 5
_BASE = 0x9E3779B97F4A7C15
_FACTORS = [U64(pow(_BASE, n, 1 << 64)) for n in range(max(ORDERS))]
_MIXERS = [U64((_BASE + 2 * n) % (1 << 64)) for n in range(max(ORDERS) + 1)]


def buckets(text: bytes) -> np.ndarray:
    """The distinct buckets of a text's n-grams, in order. A blank text has none."""
    words = text.decode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64) + U64(1)
    seen, h = np.zeros(1 << BITS, bool), points
    for n in range(2, max(ORDERS) + 1):
        if len(points) < n:
            break
        h = h[:-1] + points[n - 1 :] * _FACTORS[n - 1]
        if n in ORDERS:
            mixed = (h ^ (h >> U64(29))) * _MIXERS[n]
            seen[(mixed >> U64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen)


@dataclass
class ToxicityModel:
    """A weight per bucket and a constant."""

    weights: np.ndarray
    constant: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        margin = np.array([self.weights[buckets(t)].sum(dtype=np.float64) for t in texts]) + self.constant
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))

    def score(self, docs: DataFrame, text_column: str = "text", to: str = "score") -> DataFrame:
        """``docs`` with a score between 0 and 1; null and empty texts get that of a text without n-grams."""
        model = self

        @F.arrow_udf("double")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                batch = pa.record_batch([texts], names=["text"])
                parts = [model.scores(p.column("text").to_pylist()) for p in pieces([batch], "text")]
                yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

        return docs.withColumn(to, run(as_bytes(text_column)))


def held_out(id_column: str = "doc_id"):
    """Whether labels of this id are kept from training. A null id never is."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, most: int) -> DataFrame:
    """(text, label) of labelled documents: at most ``most`` labels, so the join may broadcast them (16 bytes each)."""
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1) & ~held_out(id_column))
    known = known.groupBy(F.col(id_column).cast("long").alias("id")).agg(F.max(label_column).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), as_bytes(text_column).alias("text"))
    return rows.join(F.broadcast(drawn), "id").select("text", "label")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    training_rows: int = TRAINING_ROWS,
) -> ToxicityModel:
    """Learn from labelled documents that are not held out.

    Null labels and values other than 0 and 1 are no labels; an id labelled twice is toxic if either says so. Without labels of
    both classes the model says the share of toxic labels (0 if there is none) for every text.

    Null and empty texts count as texts without n-grams, repeated rows as often as they stand; other columns are ignored.

    Scale: at most ``training_rows`` labels are used; texts of these are read once and written to the shared folder. The driver
    gets one row per bucket (2 ** 18 at most).
    """
    texts = cut_lineage(training_texts(docs, labels, id_column, text_column, label_column, training_rows), "toxicity-texts")
    size = 1 << BITS
    n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    if not toxic or not other:
        share = min(max(toxic / max(toxic + other, 1), 1e-9), 1 - 1e-9)
        return ToxicityModel(np.zeros(size, np.float32), float(np.log(share / (1 - share))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, size), np.int64)
        for batch in pieces(batches, "text"):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found[label, buckets(text)] += 1
        at = np.flatnonzero(found.any(0))
        yield pa.record_batch([pa.array(at), pa.array(found[1, at]), pa.array(found[0, at])], names=["bucket", "p", "q"])

    rows = texts.mapInArrow(count, "bucket long, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    table = rows.toArrow()
    if not len(table):  # only blank texts
        return ToxicityModel(np.zeros(size, np.float32), float(np.log(toxic / other)))
    p, q = np.zeros(size), np.zeros(size)
    p[table.column("bucket").to_numpy()] = table.column("p").to_numpy()
    q[table.column("bucket").to_numpy()] = table.column("q").to_numpy()
    ratio = np.log((p + SMOOTHING) / (p + SMOOTHING).sum()) - np.log((q + SMOOTHING) / (q + SMOOTHING).sum())

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [buckets(t).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(found, pa.list_(pa.int32())), batch.column("label")], names=["buckets", "label"])

    # kept by the executors; where one is lost its rows are made again from the written texts
    data = texts.mapInArrow(listed, "buckets array<int>, label int").persist()
    try:
        weights, constant = solve(data, ratio, toxic, other)
    finally:
        data.unpersist()
    return ToxicityModel(weights.astype(np.float32), constant)


def error_sums(rows: DataFrame, weights: np.ndarray, constant: float) -> np.ndarray:
    """Of a model over rows of (buckets, label): the sum of the errors per bucket, then that of all errors and that of all losses.

    The tasks' sums are added where they run; the driver gets a number per bucket, whatever the number of rows or tasks.
    """
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size + 2)
        for batch in batches:
            for first in range(0, len(batch), STEP):
                part = batch.slice(first, STEP)
                at, y = part.column("buckets").offsets.to_numpy(), part.column("label").to_numpy()
                found = part.column("buckets").values.to_numpy()[at[0] : at[-1]]
                row = np.repeat(np.arange(len(y)), np.diff(at))
                margin = np.bincount(row, weights[found], len(y)) + constant
                error = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y
                sums[:size] += np.bincount(found, error[row], size)
                sums[size:] += error.sum(), (np.logaddexp(0, margin) - y * margin).sum()
        whole = np.r_[sums, np.zeros(-len(sums) % PIECE)].reshape(-1, PIECE)
        yield pa.record_batch([pa.array(np.arange(len(whole))), pa.array(list(whole))], names=["piece", "numbers"])

    made = rows.mapInArrow(run, "piece long, numbers array<double>")
    added = made.groupBy("piece").agg(Summarizer.sum(array_to_vector("numbers")).alias("v"))
    table = added.select("piece", vector_to_array("v").alias("v")).toArrow().sort_by("piece")
    return table.column("v").combine_chunks().flatten().to_numpy()[: size + 2]


def solve(rows: DataFrame, ratio: np.ndarray, toxic: int, other: int) -> tuple[np.ndarray, float]:
    """(weight per bucket, constant) where the mean logistic loss plus ``PENALTY`` / 2 times the squares of weight / ratio is smallest.

    L-BFGS on the scaled features themselves, a job per step. MLlib's solver is not used: it divides each feature by its deviation, which
    gives the rare buckets steps some thousand times those of the others, and it stops far from the minimum.
    """
    n = toxic + other

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        sums = error_sums(rows, x[:-1] * ratio, float(x[-1]))
        slope = np.r_[sums[:-2] * ratio / n + PENALTY * x[:-1], sums[-2] / n]
        return sums[-1] / n + PENALTY / 2 * float(x[:-1] @ x[:-1]), slope

    x = np.r_[np.zeros(len(ratio)), np.log(toxic / other)]
    now, slope = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(MOST_STEPS):
        if np.abs(slope).max() < FLAT:
            break
        way, shares = -slope, []
        for s, y in reversed(steps):
            shares.append((s @ way) / (s @ y))
            way = way - shares[-1] * y
        way = way * ((steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / np.linalg.norm(slope))
        for (s, y), share in zip(steps, reversed(shares)):
            way = way + (share - (y @ way) / (s @ y)) * s
        size, fall = 1.0, float(slope @ way)
        while (there := loss(x + size * way))[0] > now + 1e-4 * size * fall and size > 1e-6:
            size /= 2
        if there[0] >= now:  # as near as the numbers' digits allow
            break
        if (there[1] - slope) @ way > 0:
            steps = [*steps[1 - HELD_STEPS :], (size * way, there[1] - slope)]
        x, (now, slope) = x + size * way, there
    return x[:-1] * ratio, float(x[-1])


def scored(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; ``predicted`` is 1 from a score of 0.5.

    Null and empty texts get the score of a text without n-grams, null ids stay null, repeated rows and an empty table give as many
    rows as they have; other columns, whatever their names, are left out.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    out = model.score(rows.withColumn("held_out", held_out("doc_id")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicityModel, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject; all columns stay."""
    names = docs.columns
    kept = model.score(docs, text_column, "__toxicity").where(F.col("__toxicity") < 0.5)
    return kept.select(*[F.col(f"`{c}`") for c in names])
