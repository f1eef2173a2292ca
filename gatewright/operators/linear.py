"""Linear classifiers on sparse vectors: logistic loss for any number of classes, hinge loss with one class against the rest.

Rows are packed once into blocks, which the executors keep; a step of L-BFGS is a job over them that serves all classes together and
gives the driver numbers of the coefficients' own size. Large tables are solved on every 16th block first. That end and its curvature
only start the run on all rows, whose loss alone says where it ends: most steps then cost a sixteenth of a pass.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.operators.network import Rows, entries, sparse_rows

LOGISTIC, HINGE = "logistic", "hinge"
#: Rows and entries of a block at most; every which block belongs to the first run, and from how many blocks there is one.
BLOCK_ROWS, BLOCK_ENTRIES, STRIDE, MANY_BLOCKS = 4096, 1 << 20, 16, 64
#: Curvature pairs that are kept; steps over which the loss must fall by the tolerance; a slope that counts as none.
HELD, WINDOW, FLAT = 20, 5, 1e-8
#: Widths over which the kink of the hinge loss is rounded, one run after another: each lowers the loss by half its width at most.
SOFT = (0.5, 0.1, 0.02, 0.005)
ROUGH = 1e-4  # tolerance of runs that only start another
#: Numbers of all tasks' sums up to which the driver adds them; above, they are added where they are made.
FEW = 1 << 18
BLOCK_SCHEMA = "number long, offsets binary, indices binary, values binary, label binary, weight binary"
TYPES = (np.int64, np.int32, np.float64, np.float64, np.float64)


def block_rows(rows: DataFrame) -> RDD:
    """(number in its task, offsets, indices, values, label, weight) of each block of sparse rows, the latter five as bytes.

    A cached table would write its blocks into Arrow batches for every step, which takes longer than the sums; bytes go as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            table, first = Rows(batch), 0
            label, weight = (batch.column(c).to_numpy() for c in ("label", "weight"))
            while first < len(table):
                last = int(np.searchsorted(table.at, table.at[first] + BLOCK_ENTRIES, "right")) - 1
                last = min(max(last, first + 1), first + BLOCK_ROWS, len(table))
                own = slice(table.at[first], table.at[last])
                parts = [table.at[first : last + 1] - table.at[first], table.indices[own], table.values[own], label[first:last], weight[first:last]]
                cells = [pa.array([p.astype(kind).tobytes()], pa.binary()) for p, kind in zip(parts, TYPES)]
                yield pa.record_batch([pa.array([number], pa.int64()), *cells], names=["number", "offsets", "indices", "values", "label", "weight"])
                number, first = number + 1, last

    return rows.mapInArrow(run, BLOCK_SCHEMA).rdd.map(tuple)


def margins(offsets: np.ndarray, indices: np.ndarray, values: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """(columns x rows) products of sparse rows with each column of coefficients, the last of which is the constant."""
    filled = np.flatnonzero(np.diff(offsets) > 0)
    out = np.repeat(columns[:, -1:], len(offsets) - 1, axis=1)
    if len(filled):
        for k, c in enumerate(columns):
            out[k, filled] += np.add.reduceat(c[indices] * values, offsets[filled])
    return out


def errors(loss: str, made: np.ndarray, label: np.ndarray, targets: list[int], soft: float = SOFT[-1]) -> tuple[np.ndarray, np.ndarray]:
    """(slopes by margin, losses) per row and column; a softmax has the same loss once, in its first row.

    ``targets`` names the class of each column. A single column of two classes speaks for class 1. The hinge loss is a parabola
    over ``soft`` from its kink.
    """
    if loss == HINGE:
        sign = np.where(label == np.array(targets)[:, None], 1.0, -1.0)
        gap = np.maximum(1 - sign * made, 0)
        inside = np.minimum(gap, soft)
        return -sign * inside / soft, gap - inside + inside * inside / (2 * soft)
    if len(targets) == 1:
        own = (label == targets[0]).astype(float)
        share = 0.5 * (1 + np.tanh(0.5 * made))
        return share - own, np.logaddexp(0, made) - own * made
    high = made.max(axis=0)
    e = np.exp(made - high)
    total, own = e.sum(axis=0), (label == np.array(targets)[:, None]).astype(float)
    lost = np.zeros_like(made)
    lost[0] = np.log(total) + high - (own * made).sum(axis=0)
    return e / total - own, lost


def added_up(blocks: RDD, tasks: int, size: int, sums) -> np.ndarray:
    """``sums(offsets, indices, values, label, weight)``, ``size`` numbers of a block, added up over all blocks."""

    def run(part: Iterator[tuple]) -> Iterator[np.ndarray]:
        whole = np.zeros(size)
        for _, *cells in part:
            whole += sums(*(np.frombuffer(c, kind) for c, kind in zip(cells, TYPES)))
        yield whole

    made = blocks.mapPartitions(run)
    return sum(made.collect(), np.zeros(size)) if tasks * size <= FEW else made.treeReduce(np.add)


def moments(blocks: RDD, tasks: int, width: int) -> tuple[int, float, np.ndarray, np.ndarray]:
    """(blocks, weight of all rows, mean and deviation of each column)."""

    def sums(offsets, indices, values, label, weight):
        index, share = indices.astype(np.int64), np.repeat(weight, np.diff(offsets)) * values
        return np.r_[1, weight.sum(), np.bincount(index, share, width), np.bincount(index, share * values, width)]

    found = added_up(blocks, tasks, 2 * width + 2, sums)
    n, total = int(found[0]), float(found[1])
    mean, square = found[2:].reshape(2, width) / (total or 1)
    return n, total, mean, np.sqrt(np.maximum(square - mean * mean, 0))


def loss_sums(blocks: RDD, tasks: int, columns: np.ndarray, loss: str, targets: list[int], soft: float = SOFT[-1]) -> np.ndarray:
    """(columns x (width + 2)): weighted sums over all rows of the slopes, the constant's slope and the losses."""
    width = columns.shape[1] - 1

    def sums(offsets, indices, values, label, weight):
        slope, lost = errors(loss, margins(offsets, indices, values, columns), label, targets, soft)
        slope *= weight
        index, n = indices.astype(np.int64), np.diff(offsets)
        parts = [[np.bincount(index, values * np.repeat(slope[k], n), width), [slope[k].sum(), lost[k] @ weight]] for k in range(len(columns))]
        return np.concatenate([x for part in parts for x in part])

    return added_up(blocks, tasks, len(columns) * (width + 2), sums).reshape(len(columns), width + 2)


def towards(slope: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the slope times the inverse curvature that the pairs say."""
    way, shares = -slope, []
    for s, y in reversed(pairs):
        shares.append((s @ way) / (s @ y))
        way = way - shares[-1] * y
    if pairs:
        s, y = pairs[-1]
        way = way * ((s @ y) / (y @ y))
    for (s, y), share in zip(pairs, reversed(shares)):
        way = way + (share - (y @ way) / (s @ y)) * s
    return way


def descend(x: np.ndarray, most: int, tolerance: float, pairs: list) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, list]]:
    """L-BFGS as a generator: it yields points, is sent (value, slope) there and returns (last point, curvature pairs).

    Steps meet the weak Wolfe conditions. It ends where ``WINDOW`` steps lowered the value by ``tolerance`` at most, or no step along the slope lowers it.
    """
    now, slope = yield x
    before = [now]
    for _ in range(most):
        if np.abs(slope).max() <= FLAT:
            break
        way = towards(slope, pairs)
        fall = float(slope @ way)
        if fall >= 0:
            pairs, way, fall = [], -slope, -float(slope @ slope)
        low, high, size = 0.0, np.inf, 1.0 if pairs else min(1.0, 1 / float(np.linalg.norm(slope)))
        best = None
        for _ in range(20):
            value, new = yield x + size * way
            if value < (now if best is None else best[1]):
                best = (size, value, new)
            if value > now + 1e-4 * size * fall:
                high = size
            elif float(new @ way) < 0.9 * fall:
                low = size
            else:
                break
            size = (low + high) / 2 if high < np.inf else 2 * low
        if best is None:  # no step lowers it
            if not pairs:
                break
            pairs = []
            continue
        size, value, new = best
        s, y = size * way, new - slope
        if float(s @ y) > 1e-12 * float(y @ y):
            pairs = [*pairs, (s, y)][-HELD:]
        x, now, slope = x + s, value, new
        before.append(now)
        if len(before) > WINDOW and before[-1 - WINDOW] - now <= tolerance:
            break
    return x, pairs


class Problem:
    """The mean weighted loss plus ``penalty`` / 2 times the squares of the coefficients without the constants.

    Steps are taken in centred columns of deviation 1, which need fewer of them; the penalty is that of the columns as they are.
    """

    def __init__(self, loss: str, groups: list[list[int]], penalty: float, mean: np.ndarray, dev: np.ndarray, most: int, tolerance: float):
        self.loss, self.groups, self.penalty, self.most, self.tolerance = loss, groups, penalty, most, tolerance
        self.mean, self.share = mean, np.where(dev > 1e-9, 1 / np.maximum(dev, 1e-9), 0.0)

    def columns(self, x: np.ndarray, group: list[int]) -> np.ndarray:
        """Coefficients of the columns as they are, the constant last."""
        x = x.reshape(len(group), -1)
        plain = x[:, :-1] * self.share
        return np.c_[plain, x[:, -1] - plain @ self.mean]

    def solve(self, blocks: RDD, tasks: int, start: list[tuple[np.ndarray, list]], total: float, soft: float, tolerance: float) -> list[tuple[np.ndarray, list]]:
        """(last point, curvature pairs) of each group's columns; all groups take their steps in the same jobs."""
        runs = [descend(x, self.most, tolerance, pairs) for x, pairs in start]
        done: list = [None] * len(runs)
        points = {i: next(run) for i, run in enumerate(runs)}
        while points:
            own = {i: self.columns(x, self.groups[i]) for i, x in points.items()}
            sums = loss_sums(blocks, tasks, np.concatenate(list(own.values())), self.loss, [c for i in own for c in self.groups[i]], soft)
            first, points = 0, {}
            for i, columns in own.items():
                part, plain = sums[first : first + len(columns)] / total, columns[:, :-1]
                first += len(columns)
                slope = (part[:, :-2] + self.penalty * plain - part[:, -2:-1] * self.mean) * self.share
                value = part[:, -1].sum() + self.penalty / 2 * float((plain * plain).sum())
                try:
                    points[i] = runs[i].send((value, np.c_[slope, part[:, -2]].ravel()))
                except StopIteration as end:
                    done[i] = end.value
        return done

    def solve_in_runs(self, blocks: RDD, tasks: int, start: list[tuple[np.ndarray, list]], total: float, runs: int) -> list[tuple[np.ndarray, list]]:
        """:meth:`solve` by the last ``runs`` of the widths, each from the end of the one before."""
        for soft in SOFT[-runs:]:
            start = self.solve(blocks, tasks, start, total, soft, self.tolerance if soft == SOFT[-1] else max(self.tolerance, ROUGH))
        return start


class _Settings(Params):
    loss = Param(Params._dummy(), "loss", "logistic or hinge", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    regParam = Param(Params._dummy(), "regParam", "of half the squares", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "steps at most", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "fall of the mean loss, which is about 1 without a model", TypeConverters.toFloat)
    weightCol = Param(Params._dummy(), "weightCol", "a column of row weights; empty for none", TypeConverters.toString)
    coefficients = Param(Params._dummy(), "coefficients", "of each column, its constant last, one after another", TypeConverters.toListFloat)


class LinearClassifier(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Fit on (label, features and, if ``weightCol`` names one, a weight). Constants are not penalised, features are used as they are."""

    @keyword_only
    def __init__(self, *, loss: str = LOGISTIC, classes: int = 2, regParam: float = 0.0, maxIter: int = 100, tol: float = 1e-6, weightCol: str = ""):
        super().__init__()
        self._setDefault(loss=LOGISTIC, classes=2, regParam=0.0, maxIter=100, tol=1e-6, weightCol="")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, data: DataFrame) -> LinearModel:
        loss, classes, penalty = (self.getOrDefault(p) for p in ("loss", "classes", "regParam"))
        most, tolerance, name = (self.getOrDefault(p) for p in ("maxIter", "tol", "weightCol"))
        label = F.coalesce(F.col("label").cast("double"), F.raise_error(F.lit("Labels MUST NOT be null")).cast("double"))
        rows = sparse_rows(data, label.alias("label"), (F.col(name).cast("double") if name else F.lit(1.0)).alias("weight"))
        blocks = block_rows(rows).persist(StorageLevel.MEMORY_AND_DISK)
        sample, runs = None, len(SOFT) if loss == HINGE else 1
        try:
            tasks, first = blocks.getNumPartitions(), data.select(F.size(vector_to_array("features"))).first()
            if first is None:
                raise ValueError("no rows to learn from")
            n, total, mean, dev = moments(blocks, tasks, first[0])
            groups = [list(range(classes))] if loss == LOGISTIC and classes > 2 else [[c] for c in (range(classes) if classes > 2 else [1])]
            problem = Problem(loss, groups, penalty, mean, dev, most, tolerance)
            start = [(np.zeros(len(g) * (len(mean) + 1)), []) for g in groups]
            if n >= MANY_BLOCKS:
                sample = blocks.filter(lambda block: block[0] % STRIDE == 0).persist(StorageLevel.MEMORY_AND_DISK)
                start = problem.solve_in_runs(sample, tasks, start, moments(sample, tasks, len(mean))[1], runs)
                runs = 1
            done = problem.solve_in_runs(blocks, tasks, start, total, runs)
        finally:
            blocks.unpersist()
            if sample is not None:
                sample.unpersist()
        columns = [problem.columns(x, g).ravel() for (x, _), g in zip(done, groups)]
        return LinearModel(loss=loss, classes=classes, coefficients=np.concatenate(columns).tolist())


class LinearModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction``, for the logistic loss ``probability``, and ``prediction``."""

    @keyword_only
    def __init__(self, *, loss: str | None = None, classes: int | None = None, coefficients: list[float] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, data: DataFrame) -> DataFrame:
        loss, classes = self.getOrDefault("loss"), self.getOrDefault("classes")
        columns = np.array(self.getOrDefault("coefficients")).reshape(1 if classes == 2 else classes, -1)

        @F.arrow_udf("array<double>")
        def margin(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for indices, values in parts:
                table = Rows(pa.record_batch([indices, values], names=["indices", "values"]))
                first, last = table.at[0], table.at[-1]
                made = margins(table.at - first, table.indices[first:last], table.values[first:last], columns)
                made = np.concatenate([-made, made]) if classes == 2 else made
                yield pa.array(list(made.T), pa.list_(pa.float64()))

        made = data.withColumn("__raw", margin(*entries()))
        if loss == LOGISTIC:
            power = F.transform("__raw", lambda z: F.exp(z - F.array_max("__raw")) if classes > 2 else F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
            made = made.withColumn("__power", power)
            total = F.aggregate("__power", F.lit(0.0), lambda a, z: a + z) if classes > 2 else F.lit(1.0)
            made = made.withColumn("probability", array_to_vector(F.transform("__power", lambda z: z / total))).drop("__power")
        best = F.array_position("__raw", F.array_max("__raw")) - 1
        return made.withColumns({"rawPrediction": array_to_vector("__raw"), "prediction": best.cast("double")}).drop("__raw")
