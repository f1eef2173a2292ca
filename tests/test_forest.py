"""The forest on sparse vectors: splits against brute force, the same trees however they are grown, scoring, saving."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gatewright.operators import forest as T
from gatewright.operators import models as M


def table(spark, rows: int, classes: int, width: int = 9, parts: int = 1):
    """Counts and a column below 0; the last column is always 0. A fifth of the labels are noise, some vectors dense."""
    draw = np.random.default_rng(rows)
    x = draw.integers(0, 5, (rows, width)) * (draw.random((rows, width)) < 0.4) / 4
    x[:, 0] -= draw.integers(0, 3, rows)
    x[:, -1] = 0
    y = np.digitize(x[:, 1] + 2 * x[:, 2] - x[:, 0], [1.0, 2.5][: classes - 1])
    y = np.where(draw.random(rows) < 0.2, draw.integers(0, classes, rows), y)
    w = np.array([1.0, 2.5, 0.7])[y]
    data = [(k, float(y[k]), Vectors.dense(x[k]) if k % 9 == 0 else Vectors.sparse(width, [(int(i), float(x[k, i])) for i in np.flatnonzero(x[k])]), float(w[k])) for k in range(rows)]
    frame = spark.createDataFrame(data, ["id", "label", "features", "weight"])
    return x, y, w, frame.repartition(parts, "id").sortWithinPartitions("id")


def nodes(model) -> list:
    return [getattr(model, name).tolist() for name in T.ARRAYS]


def brute(x, y, w, depth, cuts, classes):
    """(column, cut, left, right) or a leaf's class shares, by trying every cut of every column."""
    total = np.bincount(y, w, classes)
    leaf = (total / total.sum()).tolist()
    if depth == 0 or (total > 0).sum() < 2:
        return leaf
    gini = lambda t: 1 - ((t / t.sum()) ** 2).sum()
    best = (1e-12, None, None)
    for c in range(x.shape[1]):
        for k, cut in enumerate(cuts[c][np.isfinite(cuts[c])]):
            side = x[:, c] <= cut
            if side.any() and not side.all():
                a, b = np.bincount(y[side], w[side], classes), np.bincount(y[~side], w[~side], classes)
                gain = gini(total) - (a.sum() * gini(a) + b.sum() * gini(b)) / total.sum()
                if gain > best[0] + 1e-12:
                    best = (gain, c, k)
    if best[1] is None:
        return leaf
    side = x[:, best[1]] <= cuts[best[1]][best[2]]
    a, b = (brute(x[s], y[s], w[s], depth - 1, cuts, classes) for s in (side, ~side))
    if all(isinstance(t[0], float) for t in (a, b)) and np.argmax(a) == np.argmax(b):
        return leaf
    return best[1], best[2], a, b


def as_tree(model, at):
    if model.column[at] < 0:
        return model.shares[model.below[at]].tolist()
    return int(model.column[at]), int(model.cut[at]), as_tree(model, model.below[at]), as_tree(model, model.below[at] + 1)


def close(a, b) -> bool:
    if isinstance(a, list) or isinstance(b, list):
        return isinstance(a, list) and isinstance(b, list) and np.allclose(a, b, atol=1e-5)
    return a[:2] == b[:2] and close(a[2], b[2]) and close(a[3], b[3])


@pytest.mark.parametrize("classes", [2, 3])
def test_a_tree_equals_brute_force(spark, classes):
    x, y, w, data = table(spark, 300, classes)
    model = T.SparseForest(classes=classes, numTrees=1, maxDepth=4, seed=3, weightCol="weight").fit(data)
    times = T.draws(3, 0, 0, 300)
    own = np.repeat(np.arange(300), times)
    assert close(as_tree(model, 0), brute(x[own], y[own], w[own], 4, model.cuts, classes))


@pytest.mark.parametrize(("classes", "width"), [(2, 90), (3, 40)])
def test_the_same_trees_by_jobs_and_by_tasks(spark, monkeypatch, classes, width):
    """However much of a tree is split by jobs and however few cells are looked at in a step."""
    *_, data = table(spark, 500, classes, width, 3)
    fit = lambda: T.SparseForest(classes=classes, numTrees=6, maxDepth=12, seed=5, weightCol="weight").fit(data)
    want = nodes(fit())
    monkeypatch.setattr(T, "UNIT", 2500)
    monkeypatch.setattr(T, "SUMS", 60_000)
    monkeypatch.setattr(T, "HELD", 5000)
    monkeypatch.setattr(T, "SENT", 30_000)
    assert nodes(fit()) == want
    monkeypatch.setattr(T, "STEP", 50)
    monkeypatch.setattr(T, "TABLE", 3 * width)
    assert nodes(fit()) == want
    monkeypatch.setattr(T, "UNIT", 0)  # jobs only
    assert nodes(fit()) == want


def test_it_learns_scores_and_is_saved(spark, tmp_path):
    x, y, w, data = table(spark, 3000, 3, parts=4)
    model = T.SparseForest(classes=3, numTrees=30, maxDepth=8, seed=1, weightCol="weight").fit(data)
    scored = model.transform(data)
    rows = {r["id"]: r for r in scored.collect()}
    for k in range(0, 3000, 60):  # by hand
        bins = T.bins_of(model.cuts, np.arange(9), x[k])
        made = np.zeros(3)
        for at in model.roots:
            while model.column[at] >= 0:
                at = model.below[at] + (bins[model.column[at]] > model.cut[at])
            made += model.shares[model.below[at]]
        assert np.allclose(rows[k]["rawPrediction"].toArray(), made) and np.allclose(rows[k]["probability"].toArray(), made / 30)
        assert int(rows[k]["prediction"]) == made.argmax()
    assert scored.filter("label = prediction").count() > 2300
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(data).orderBy("id").select("id", "probability").collect() == scored.orderBy("id").select("id", "probability").collect()


def test_quality_is_that_of_mllib(spark):
    from pyspark.ml.classification import RandomForestClassifier

    *_, data = table(spark, 2000, 2, 30, 2)
    new = table(spark, 1500, 2, 30)[3]
    own = T.SparseForest(classes=2, numTrees=40, maxDepth=10, seed=2, weightCol="weight").fit(data)
    other = RandomForestClassifier(numTrees=40, maxDepth=10, seed=2, weightCol="weight").fit(data)
    right = [m.transform(new).filter("label = prediction").count() / 1500 for m in (own, other)]
    assert abs(right[0] - right[1]) < 0.04
    assert abs(len(own.column) / other.totalNumNodes - 1) < 0.1


def test_jobs_do_not_grow_with_the_levels(spark):
    """MLlib's forest passes over all rows once a level at least."""
    *_, data = table(spark, 800, 2, 12)
    estimator = M.candidates("commit_risk", 800, 12)["Random Forest"]
    spark.sparkContext.setJobGroup("forest", "forest")
    try:
        model = estimator.fit(data)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest")) <= 12
    assert len(model.roots) == 100


def test_bounds_are_those_of_mllib():
    few = T.bounds_of(np.array([2.0, 1.0, 2.0]), np.ones(3), 5.0)
    assert few == [0.5, 1.5]  # with the zeros that are left of 5
    assert T.bounds_of(np.array([-1.0, 3.0]), np.ones(2), 2.0) == [1.0]
    many = T.bounds_of(np.arange(1.0, 101.0), np.ones(100), 100.0)
    assert len(many) == 31 and np.allclose(np.diff(many), 100 / 32, atol=1)


def test_columns_of_flags_and_wrong_labels(spark):
    sample = T.sparse_rows(table(spark, 40, 2)[3], F.col("weight")).toArrow()
    assert T.bounds(sample, 9, [8])[8, 0] == 0.5 and np.isinf(T.bounds(sample, 9, [])[8, 0])
    data = table(spark, 40, 2)[3]
    for wrong in (None, 2.0, 0.5):
        with pytest.raises(Exception, match="whole numbers"):
            T.SparseForest(classes=2).fit(data.withColumn("label", F.lit(wrong).cast("double")))
    with pytest.raises(ValueError, match="no rows"):
        T.SparseForest(classes=2).fit(data.limit(0))


def test_drawn_columns_differ_and_repeat():
    for width, m in ((5000, 71), (60, 8), (9, 9), (1000, 1)):
        a = T.drawn_columns(1, 2, np.arange(1, 300), width, m)
        assert a.shape == (299, m) and all(len(set(r)) == m for r in a.tolist()) and a.min() >= 0 and a.max() < width
        assert (T.drawn_columns(1, 2, np.array([7]), width, m) == a[6]).all()
    assert abs(np.bincount(T.drawn_columns(1, 2, np.arange(1, 5000), 90, 10).ravel(), minlength=90).mean() - 4999 / 9) < 1
