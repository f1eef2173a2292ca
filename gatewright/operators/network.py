"""A feed-forward network on sparse vectors: ReLU layers, softmax, Adam on small batches, one Spark job an epoch.

Each task takes the weights of the epoch before through its part of the rows, batch by batch, and returns its weights; their mean, by
rows, is the epoch's result, summed where the tasks run and not on the driver. One part is plain mini-batch training. The first layer
only touches the rows of its matrix whose terms a batch has, so a text costs its own terms, not the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.session import short_lived_shuffles

#: Adam and the penalty as commonly set; training ends when the loss did not fall by TOLERANCE for PATIENCE epochs.
BETA1, BETA2, EPSILON, PENALTY = 0.9, 0.999, 1e-8, 1e-4
BATCH, TOLERANCE, PATIENCE = 200, 1e-4, 10
#: Numbers in a piece of the weights on their way through the shuffle.
PIECE = 8192


class Rows:
    """Sparse vectors of a record batch: offsets, indices and values."""

    def __init__(self, batch: pa.RecordBatch):
        indices, values = batch.column("indices"), batch.column("values")
        self.at = indices.offsets.to_numpy().astype(np.int64)
        self.indices = indices.values.to_numpy()
        self.values = values.values.to_numpy()

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row number from 0, index, value) of the entries of some rows."""
        n = self.at[rows + 1] - self.at[rows]
        place = np.repeat(self.at[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(rows)), n), self.indices[place], self.values[place]


def initial(layers: list[int], seed: int) -> np.ndarray:
    """Glorot's uniform weights, all in one vector."""
    draw, parts = np.random.default_rng(seed), []
    for a, b in zip(layers, layers[1:]):
        bound = np.sqrt(6 / (a + b)) if b != layers[-1] else np.sqrt(2 / (a + b))
        parts += [draw.uniform(-bound, bound, a * b), draw.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def unpacked(flat: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the weights: (matrix, constants) of each layer."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def filled(row: np.ndarray, index: np.ndarray, value: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms that a batch has, its rows over these terms): products of matrices take a fraction of the time of sums by entries."""
    has = np.zeros(width, bool)
    has[index] = True
    terms, x = np.flatnonzero(has), np.zeros((n, has.sum()))
    x[row, (np.cumsum(has) - 1)[index]] = value
    return terms, x


def forward(weights: list, terms: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Outputs of all layers, the last as probabilities."""
    first, constant = weights[0]
    z = x @ first[terms] + constant
    out = []
    for k in range(1, len(weights) + 1):
        if k == len(weights):
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
        else:
            out.append(np.maximum(z, 0))
            z = out[-1] @ weights[k][0] + weights[k][1]
    return out


def gradient(flat: np.ndarray, layers: list[int], entries: tuple, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """(gradient, mean loss) of a batch."""
    weights, out = unpacked(flat, layers), np.zeros_like(flat)
    terms, x = filled(*entries, len(y), layers[0])
    made, slots = forward(weights, terms, x), unpacked(out, layers)
    share = weight / len(y)
    loss = float(-(share * np.log(np.maximum(made[-1][np.arange(len(y)), y], 1e-12))).sum())
    delta = made[-1].copy()
    delta[np.arange(len(y)), y] -= 1
    delta *= share[:, None]
    for k in range(len(weights) - 1, 0, -1):
        slots[k][0][:] = made[k - 1].T @ delta + PENALTY / len(y) * weights[k][0]
        slots[k][1][:] = delta.sum(axis=0)
        delta = (delta @ weights[k][0].T) * (made[k - 1] > 0)
    slots[0][0][terms] = x.T @ delta
    slots[0][0][:] += PENALTY / len(y) * weights[0][0]
    slots[0][1][:] = delta.sum(axis=0)
    return out, loss


def epoch(rows: DataFrame, state: np.ndarray, layers: list[int], steps: int, number: int, seed: int, rate: float) -> tuple[np.ndarray, float, float]:
    """(weights and moments after an epoch, mean loss, mean number of batches a task). ``state``: weights, first and second moments.

    The driver gets the state's own size, whatever the number of tasks.
    """
    size = len(state) // 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, m, v = (part.copy() for part in np.split(state, 3))
        step, seen, total = steps, 0, 0.0
        for k, batch in enumerate(batches):
            table, y = Rows(batch), batch.column("label").to_numpy().astype(np.int64)
            weight = batch.column("weight").to_numpy()
            order = np.random.default_rng([seed, number, k]).permutation(len(table))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                g, loss = gradient(flat, layers, table.take(some), y[some], weight[some])
                step += 1
                m += (1 - BETA1) * (g - m)
                v += (1 - BETA2) * (g * g - v)
                flat -= rate * np.sqrt(1 - BETA2**step) / (1 - BETA1**step) * m / (np.sqrt(v) + EPSILON)
                seen, total = seen + len(some), total + loss * len(some)
        if seen:
            whole = np.concatenate([flat, m, v, [total / seen, step - steps]])
            whole = np.r_[whole, np.zeros(-len(whole) % PIECE)].reshape(-1, PIECE)
            yield pa.record_batch([pa.array(np.arange(len(whole))), pa.array(list(whole)), pa.array(np.full(len(whole), float(seen)))], names=["piece", "numbers", "rows"])

    made = rows.mapInArrow(run, "piece long, numbers array<double>, rows double")
    mean = made.groupBy("piece").agg(Summarizer.mean(array_to_vector("numbers"), F.col("rows")).alias("v"))
    pieces = mean.select("piece", vector_to_array("v").alias("v")).toArrow().sort_by("piece")
    whole = pieces.column("v").combine_chunks().flatten().to_numpy()
    return whole[: 3 * size], float(whole[3 * size]), float(whole[3 * size + 1])


def entries() -> tuple[Column, Column]:
    """(indices, values) of ``features``, sparse or dense."""
    v = F.unwrap_udt("features")
    dense = F.sequence(F.lit(0), F.size(v["values"]) - 1)
    return F.when(F.size(v["values"]) == 0, F.array().cast("array<int>")).otherwise(F.coalesce(v["indices"], dense)), v["values"]


def sparse_rows(data: DataFrame, *columns) -> DataFrame:
    """(indices, values, ...) of ``features``."""
    indices, values = entries()
    return data.select(indices.alias("indices"), values.alias("values"), *columns)


class _Settings(Params):
    layers = Param(Params._dummy(), "layers", "inputs, hidden units, classes", TypeConverters.toListInt)
    maxIter = Param(Params._dummy(), "maxIter", "epochs at most", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the weights and of the order of rows", TypeConverters.toInt)
    weightCol = Param(Params._dummy(), "weightCol", "a column of row weights; empty for none", TypeConverters.toString)
    stepSize = Param(Params._dummy(), "stepSize", "of Adam", TypeConverters.toFloat)
    weights = Param(Params._dummy(), "weights", "all weights of the fitted network", TypeConverters.toListFloat)


class SparseNetwork(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Fit on (label, features and, if ``weightCol`` names one, a weight); the network's weights are a few MB, bounded by the layers, and travel with every task."""

    @keyword_only
    def __init__(self, *, layers: list[int] | None = None, maxIter: int = 200, seed: int = 42, stepSize: float = 1e-3, weightCol: str = ""):
        super().__init__()
        self._setDefault(maxIter=200, seed=42, stepSize=1e-3, weightCol="")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.losses: list[float] = []

    def _fit(self, data: DataFrame) -> SparseNetworkModel:
        layers, seed = self.getOrDefault("layers"), self.getOrDefault("seed")
        name = self.getOrDefault("weightCol")
        weight = F.col(name).cast("double") if name else F.lit(1.0)
        rows = sparse_rows(data, F.col("label").cast("long").alias("label"), weight.alias("weight")).persist()
        flat = initial(layers, seed)
        state, steps, best, idle = np.concatenate([flat, np.zeros(2 * len(flat))]), 0.0, np.inf, 0
        self.losses = []
        try:
            for number in range(self.getOrDefault("maxIter")):
                with short_lived_shuffles(data.sparkSession):
                    state, loss, more = epoch(rows, state, layers, round(steps), number, seed, self.getOrDefault("stepSize"))
                steps += more
                self.losses.append(loss)
                idle = 0 if loss < best - TOLERANCE else idle + 1
                best = min(best, loss)
                if idle >= PATIENCE:
                    break
        finally:
            rows.unpersist()
        return SparseNetworkModel(layers=layers, weights=state[: len(flat)].tolist())


class SparseNetworkModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` and ``prediction``."""

    @keyword_only
    def __init__(self, *, layers: list[int] | None = None, weights: list[float] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, data: DataFrame) -> DataFrame:
        layers, flat = self.getOrDefault("layers"), np.array(self.getOrDefault("weights"))

        @F.arrow_udf("array<double>")
        def classes(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            weights = unpacked(flat, layers)
            for indices, values in parts:
                table, out = Rows(pa.record_batch([indices, values], names=["indices", "values"])), []
                for at in range(0, len(table), BATCH):
                    some = np.arange(at, min(at + BATCH, len(table)))
                    out += list(forward(weights, *filled(*table.take(some), len(some), layers[0]))[-1])
                yield pa.array(out, pa.list_(pa.float64()))

        made = data.withColumn("__classes", classes(*entries()))
        best = F.array_position("__classes", F.array_max("__classes")) - 1
        return made.withColumns({"probability": array_to_vector("__classes"), "prediction": best.cast("double")}).drop("__classes")
