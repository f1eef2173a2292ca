"""Linear classifiers: sums against brute force, minima, blocks, scoring."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gatewright.operators import linear as L
from gatewright.operators.network import sparse_rows


def table(spark, classes: int, rows: int = 400):
    """Six columns, the last always 0, one row without entries; a third of the labels are noise."""
    draw = np.random.default_rng(7)
    x = draw.normal(size=(rows, 6)) * (draw.random((rows, 6)) < 0.5) * [1, 5, 0.1, 1, 1, 0]
    x[0] = 0
    y = np.where(draw.random(rows) < 0.3, draw.integers(0, classes, rows), np.digitize(x @ [1, 0.3, 4, -1, 0, 0], [0.0, 1.0][: classes - 1]))
    w = draw.uniform(0.5, 2, rows)
    data = [(float(b), Vectors.sparse(6, [(int(i), float(a[i])) for i in np.flatnonzero(a)]) if k % 2 else Vectors.dense(a), float(c)) for k, (a, b, c) in enumerate(zip(x, y, w))]
    return x, y, w, spark.createDataFrame(data, ["label", "features", "weight"]).repartition(3)


def objective(x, y, w, columns, loss, penalty):
    made = columns[:, :-1] @ x.T + columns[:, -1:]
    square = penalty / 2 * (columns[:, :-1] ** 2).sum()
    if loss == L.HINGE:
        return [(w * np.maximum(0, 1 - np.where(y == k, 1, -1) * made[i])).sum() / w.sum() + penalty / 2 * (columns[i, :-1] ** 2).sum() for i, k in enumerate([1] if len(columns) == 1 else range(len(columns)))]
    if len(columns) == 1:
        return [(w * (np.logaddexp(0, made[0]) - y * made[0])).sum() / w.sum() + square]
    return [(w * (np.log(np.exp(made).sum(axis=0)) - made[y.astype(int), np.arange(len(y))])).sum() / w.sum() + square]


@pytest.mark.parametrize("loss,classes", [(L.LOGISTIC, 2), (L.LOGISTIC, 3), (L.HINGE, 2), (L.HINGE, 3)])
def test_minimum_and_scores(spark, tmp_path, loss, classes):
    x, y, w, data = table(spark, classes)
    model = L.LinearClassifier(loss=loss, classes=classes, regParam=0.01, maxIter=500, weightCol="weight").fit(data)
    columns = np.array(model.getOrDefault("coefficients")).reshape(-1, 7)
    found = objective(x, y, w, columns, loss, 0.01)
    assert abs(columns[:, 5]).max() == 0
    draw = np.random.default_rng(3)  # no near point has a lower loss, but for the rounded kink
    for _ in range(200):
        near = objective(x, y, w, columns + draw.normal(size=columns.shape) * draw.choice([1e-3, 1e-2, 0.1, 1]), loss, 0.01)
        assert all(a <= b + (L.SOFT[-1] if loss == L.HINGE else 1e-5) for a, b in zip(found, near))
    if loss == L.LOGISTIC:
        other = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=500, standardization=False).fit(data)
        theirs = np.c_[other.coefficientMatrix.toArray(), other.interceptVector.toArray()]
        assert found[0] <= objective(x, y, w, theirs, loss, 0.01)[0] + 1e-5
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    rows = PipelineModel.load(str(tmp_path / "m")).transform(data).collect()
    made = np.array([columns[:, :-1] @ r["features"].toArray() + columns[:, -1] for r in rows])
    want = (made[:, 0] > 0).astype(int) if classes == 2 else made.argmax(axis=1)
    assert [int(r["prediction"]) for r in rows] == want.tolist()
    assert np.allclose([r["rawPrediction"].toArray()[-1] for r in rows], made[:, -1])
    if loss == L.LOGISTIC:
        chance = np.array([r["probability"].toArray() for r in rows])
        assert np.allclose(chance.sum(axis=1), 1) and (chance.argmax(axis=1) == want).all()


def test_sample_only_starts_the_run_on_all_rows(spark, monkeypatch):
    """Many blocks: the first run sees every STRIDE-th, the end is that of all rows, and full passes are few."""
    x, y, w, data = table(spark, 3, 2000)
    one = L.LinearClassifier(loss=L.LOGISTIC, classes=3, regParam=0.01, maxIter=500, tol=1e-9, weightCol="weight").fit(data)
    monkeypatch.setattr(L, "BLOCK_ROWS", 20)
    passes = []
    sums = L.loss_sums
    monkeypatch.setattr(L, "loss_sums", lambda blocks, *rest: passes.append(blocks.id()) or sums(blocks, *rest))
    two = L.LinearClassifier(loss=L.LOGISTIC, classes=3, regParam=0.01, maxIter=500, tol=1e-9, weightCol="weight").fit(data)
    ends = [objective(x, y, w, np.array(m.getOrDefault("coefficients")).reshape(3, 7), L.LOGISTIC, 0.01)[0] for m in (one, two)]
    assert abs(ends[0] - ends[1]) < 1e-6
    assert len(set(passes)) == 2 and passes.count(passes[-1]) < len(passes)


def test_blocks_hold_all_rows_and_null_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ENTRIES", 7)
    x, y, w, data = table(spark, 2)
    rows = sparse_rows(data, F.col("label").alias("label"), F.col("weight").alias("weight"))
    blocks = L.block_rows(rows)
    n, total, mean, dev = L.moments(blocks, 3, 6)
    assert n > 100 and np.isclose(total, w.sum())
    assert np.allclose(mean, (w @ x) / w.sum()) and np.allclose(dev**2, (w @ (x - mean) ** 2) / w.sum())
    with pytest.raises(Exception, match="NOT be null"):
        L.LinearClassifier(classes=2).fit(data.withColumn("label", F.lit(None).cast("double")))
    with pytest.raises(ValueError, match="no rows"):
        L.LinearClassifier(classes=2).fit(data.limit(0))
