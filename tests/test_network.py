"""The network on sparse vectors: gradients, training in one or many parts, prediction, saving."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gatewright.operators import network as N
from gatewright.session import scratch_dir


def entries(x):
    row, index = np.nonzero(x)
    return row, index, x[row, index]


@pytest.mark.parametrize("layers", [[7, 5, 3], [7, 6, 4, 2]])
def test_gradients_equal_differences(layers):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(6, 7)) * (draw.random((6, 7)) < 0.5)
    x[2] = 0  # a row without entries
    y, weight = draw.integers(0, layers[-1], 6), draw.random(6) + 0.5
    flat = N.initial(layers, 3)

    def loss(w):
        out = N.gradient(w, layers, entries(x), y, weight)[1]
        return out + N.PENALTY / 2 / 6 * sum((m**2).sum() for m, _ in N.unpacked(w, layers))

    g = N.gradient(flat, layers, entries(x), y, weight)[0]
    for i in draw.choice(len(flat), 40, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-6 - g[i]) < 1e-6


def table(spark, n, seed, classes=3, width=300):
    """Each class has ten terms of its own among common ones."""
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(draw.integers(0, classes))
        terms = sorted({*(10 * y + draw.choice(10, 2)).tolist(), *draw.integers(50, width, 12).tolist()})
        vector = Vectors.sparse(width, terms, [1 / len(terms) ** 0.5] * len(terms))
        rows.append((i, float(y), Vectors.dense(vector.toArray()) if i % 50 == 0 else vector, 1.0))
    return spark.createDataFrame(rows, ["id", "label", "features", "weight"])


@pytest.mark.parametrize(("parts", "layers"), [(1, [300, 16, 3]), (4, [300, 24, 12, 3])])
def test_training_finds_the_classes(spark, parts, layers):
    train, new = table(spark, 1200, 1).repartition(parts, "id").sortWithinPartitions("id"), table(spark, 300, 2)
    fit = N.SparseNetwork(layers=layers, maxIter=12, seed=5, stepSize=0.02)
    model = fit.fit(train)
    assert fit.losses[-1] < 0.3 * fit.losses[0]
    scored = model.transform(new)
    assert scored.filter("label = prediction").count() > 285
    assert {round(sum(r["probability"]), 9) for r in scored.select("probability").collect()} == {1.0}
    assert model.getOrDefault("weights") == N.SparseNetwork(layers=layers, maxIter=12, seed=5, stepSize=0.02).fit(train).getOrDefault("weights")


def test_a_saved_network_says_the_same(spark):
    rows = table(spark, 200, 3)
    model = PipelineModel([N.SparseNetwork(layers=[300, 8, 3], maxIter=2).fit(rows)])
    path = scratch_dir(spark, "network")
    model.write().overwrite().save(path)
    a, b = (m.transform(rows).select("id", "probability").orderBy("id").collect() for m in (model, PipelineModel.load(path)))
    assert a == b


def test_training_ends_when_the_loss_stays(spark):
    rows = table(spark, 60, 4).withColumn("label", F.lit(1.0))
    fit = N.SparseNetwork(layers=[300, 4, 3], maxIter=60, seed=1, stepSize=0.05)
    fit.fit(rows)
    assert len(fit.losses) < 60


def test_a_batch_is_a_matrix_of_its_own_terms():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(30, 5000)) * (draw.random((30, 5000)) < 0.01)
    x[7] = 0
    terms, own = N.filled(*entries(x), 30, 5000)
    assert terms.tolist() == np.flatnonzero(x.any(axis=0)).tolist() and (own == x[:, terms]).all()
    layers, y = [5000, 6, 2], draw.integers(0, 2, 30)
    weights = N.unpacked(N.initial(layers, 1), layers)
    out = N.forward(weights, terms, own)
    assert np.allclose(out[0], np.maximum(x @ weights[0][0] + weights[0][1], 0))
    terms, own = N.filled(*entries(np.zeros((2, 9))), 2, 9)  # no entries at all
    assert own.shape == (2, 0) and N.gradient(N.initial([9, 3, 2], 1), [9, 3, 2], entries(np.zeros((2, 9))), y[:2], np.ones(2))[1] > 0


def test_epochs_leave_no_shuffles(spark, monkeypatch):
    """Every epoch runs where the files of its shuffle are deleted after it; then the session's setting is as it was."""
    from gatewright.session import short_lived_shuffles

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with short_lived_shuffles(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before
    seen, epoch = [], N.epoch
    monkeypatch.setattr(N, "epoch", lambda *a: (seen.append(spark.conf.get(name, None)), epoch(*a))[1])
    N.SparseNetwork(layers=[300, 4, 3], maxIter=3, seed=1).fit(table(spark, 60, 4))
    assert seen == ["true"] * 3 and spark.conf.get(name, None) == before
