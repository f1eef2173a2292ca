"""Small groups meet in batches: the same results as one by one, in few calls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gatewright.operators import batches as B
from gatewright.operators import detectors as D
from gatewright.operators import neighbours as K


def test_batches_follow_rows_not_groups(spark):
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert B.batches_for(spark, None) == B.batches_for(spark, 10) == least
    assert B.batches_for(spark, 10**7) == -(-(10**7) // B.BATCH_ROWS)
    rows = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("repo_id"), F.col("id").alias("v"))
    calls = spark.sparkContext.accumulator(0)

    def both(a, b, groups):
        calls.add(1)
        return pd.DataFrame([(a["repo_id"].iloc[i[0]], int(a["v"].iloc[i].sum()), int(b["v"].iloc[j].sum())) for i, j in groups], columns=["repo_id", "a", "b"])

    found = B.met_in_batches(rows, rows.filter("repo_id < '5'"), ["repo_id"], least, both, "repo_id string, a long, b long").toPandas()
    want = rows.filter("repo_id < '5'").groupBy("repo_id").agg(F.sum("v").alias("s")).toPandas().set_index("repo_id")["s"]
    assert len(found) == len(want) and (found["a"] == want.loc[found["repo_id"]].to_numpy()).all() and (found["a"] == found["b"]).all()
    assert calls.value <= least


def test_forests_that_are_not_kept_score_as_kept_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{r}", f"{i:04d}", [float(v) for v in np.round(rng.normal(size=3), 1)]) for r, n in enumerate((1, 2, 30, 400)) for i in range(n)]
    train = spark.createDataFrame(rows, "repo_id string, run_id string, x array<double>")
    asked = train.filter("run_id < '0020'").withColumn("label", F.lit(1)).unionByName(
        spark.createDataFrame([("none", "1", [0.0, 0.0, 0.0], 1)], "repo_id string, run_id string, x array<double>, label int"))
    kept = D.forest_score(asked, D.fit_forest(train, trees=20)).toPandas().sort_values(["repo_id", "run_id"])
    grown = D.grown_forest_score(asked, train, trees=20).toPandas().sort_values(["repo_id", "run_id"])
    assert len(grown) == 1 + 2 + 20 + 20 and list(kept["sample_score"]) == list(grown["sample_score"])
    assert list(kept["repo_id"]) == list(grown["repo_id"]) and list(kept["label"]) == list(grown["label"])


def test_a_forest_is_the_same_whatever_grows_beside_it():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(60, 4)), 1)
    frame = pd.DataFrame({"repo_id": np.repeat(["a", "b", "c"], 20), "n": 20, "tree": -1, "draw": 0.0, "point": "p", "x": list(x)})
    groups = [np.arange(0, 20), np.arange(20, 40), np.arange(40, 60)]
    all_, alone = D._grown(frame, groups, 10, 256, 7), D._grown(frame, groups[1:2], 10, 256, 7)
    own = all_["owner"] == 1
    for c in ("feature", "threshold", "length"):
        assert np.array_equal(all_[c][own], alone[c])


def test_split_ranges_take_the_varying_feature_of_the_largest_draw():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, size=(40, 5)).astype(float)
    sizes = np.array([1, 2, 3, 10, 24])
    row, drawn = rng.permutation(40), rng.random((5, 5))
    pick, low, high = D._split_ranges(x, row, sizes, drawn)
    at = 0
    for i, n in enumerate(sizes):
        part = x[row[at : at + n]]
        best = np.where(part.max(0) > part.min(0), drawn[i], -1).argmax()
        assert (part[:, pick[i]].max() > part[:, pick[i]].min()) == (high[i] > low[i])
        if high[i] > low[i]:
            assert (pick[i], low[i], high[i]) == (best, part[:, best].min(), part[:, best].max())
        at += n


def test_nearest_of_a_batch_with_copies_ties_and_large_numbers():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(0, 4, size=(80, 3)).astype(float), 1e6 + rng.normal(size=(40, 3))])
    repo, name = np.repeat(["g", "h"], [80, 40]), np.array([f"{i:03d}" for i in rng.permutation(120)])
    weight = rng.integers(1, 4, size=120)
    points = pd.DataFrame({"repo_id": repo, "point": name, "x": list(x), "weight": weight})
    groups = [(np.arange(80), np.arange(80)), (np.arange(80, 120), np.arange(80, 120))]
    got = K._nearest(points, points, groups, 5)
    for i in range(120):
        own = [j for j in range(120) if repo[j] == repo[i]]
        d = {j: round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), K.DIGITS) for j in own}
        left, want = 5, []
        for j in sorted(own, key=lambda j: (d[j], name[j])):
            w = min(left, weight[j] - (i == j))
            if w > 0:
                want.append((name[j], d[j], w))
                left -= w
        mine = got[got["point"] == name[i]]
        assert [(a, round(b, 9), c) for a, b, c in zip(mine["neighbour"], mine["distance"], mine["weight"])] == want


def test_a_point_without_a_name_comes_last_and_is_its_own():
    points = pd.DataFrame({"repo_id": "g", "point": ["b", None, "a"], "x": [np.array([0.0]), np.array([0.0]), np.array([0.0])], "weight": [1, 1, 1]})
    got = K._nearest(points, points, [(np.arange(3), np.arange(3))], 1)
    assert got["neighbour"].tolist() == ["a", "a", "b"]
