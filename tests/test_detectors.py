"""Neighbours, outlier factor, forest, RBF score, detector selection."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.operators import detectors as D
from gatewright.operators.neighbours import knn, local_outlier_factor, weighted_points
from gatewright.plans import anomaly as N


def points(spark, n, width, seed, repo="r", grid=6):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)) * grid) / grid
    rows = [(repo, f"{i:05d}", *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "repo_id string, run_id string, " + ", ".join(f"x{j} double" for j in range(width))), x


def brute(x, k):
    """Per row: distances of its k nearest other rows."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize(("leaf", "chunk", "fan"), [(5000, 5000, 64), (40, 30, 64), (20, 1000, 4), (60, 1000, 8)])
def test_neighbours_are_exact_however_the_tree_is_cut(spark, leaf, chunk, fan):
    df, x = points(spark, 600, 3, 4)
    other, _ = points(spark, 30, 3, 5, repo="small")
    pts = weighted_points(df.unionByName(other), ["x0", "x1", "x2"])
    near = knn(pts, 5, leaf, chunk, fan).toPandas()
    assert set(near[near["repo_id"] == "small"]["point"]) == {r["point"] for r in pts.where("repo_id = 'small'").collect()}
    near = near[near["repo_id"] == "r"]
    want = brute(x, 5)
    names = {tuple(r["x"]): r["point"] for r in pts.where("repo_id = 'r'").collect()}
    for i in range(0, 600, 7):
        mine = near[near["point"] == names[tuple(x[i])]]
        assert np.allclose(np.sort(np.repeat(mine["distance"], mine["weight"])), want[i], atol=1e-8)


def test_few_pairs_are_compared(spark):
    df, x = points(spark, 12_000, 3, 9, grid=10**6)
    visits = []
    near = knn(weighted_points(df, ["x0", "x1", "x2"]), 5, leaf=150, visits=visits).toPandas()
    pairs = sum(v.first()["pairs"] for v in visits)
    assert pairs < 12_000**2 / 12
    d = np.sort(np.sqrt(((x[:50, None] - x[None]) ** 2).sum(-1)), axis=1)[:, 1:6]
    got = near[near["point"] < "00050"].sort_values(["point", "distance"])["distance"].to_numpy().reshape(50, 5)
    assert np.allclose(got, d, atol=1e-8)


def test_outlier_factor_is_the_same_however_it_is_cut(spark):
    df, x = points(spark, 300, 2, 5, grid=50)
    df = df.unionByName(spark.createDataFrame([("r", "99999", 9.0, 9.0)], df.schema))
    a = local_outlier_factor(df, ["x0", "x1"], 10).toPandas().set_index("run_id")
    b = local_outlier_factor(df, ["x0", "x1"], 10, leaf=30, chunk=25).toPandas().set_index("run_id")
    assert np.allclose(a["lof_score"], b.loc[a.index, "lof_score"], atol=1e-5)
    assert a["lof_score"].idxmin() == "99999" and a.loc["99999", "prediction"] == -1
    assert abs((a["prediction"] == -1).mean() - 0.1) < 0.02


def scaled(df, width):
    return df.select("repo_id", "run_id", F.array(*[f"x{j}" for j in range(width)]).alias("x"))


@pytest.mark.parametrize("n", [120, 1500])
def test_forest_finds_planted_outliers_and_repeats(spark, n):
    df, _ = points(spark, n, 4, 6, grid=1000)
    odd = spark.createDataFrame([("r", f"odd{i}", *[8.0 * (-1) ** i] * 4) for i in range(5)], df.schema)
    rows = scaled(df.unionByName(odd), 4)
    forest = D.fit_forest(rows)
    one = {r["run_id"]: r["sample_score"] for r in D.forest_score(rows, forest).collect()}
    two = {r["run_id"]: r["sample_score"] for r in D.forest_score(rows.repartition(3), D.fit_forest(rows.repartition(5))).collect()}
    assert one == two
    assert set(sorted(one, key=one.get)[:5]) == {f"odd{i}" for i in range(5)}
    assert all(-1 < s < 0 for s in one.values())
    info = forest.first()
    assert info["sample_size"] == min(256, n + 5) and len(info["feature"]) <= 100 * 511
    verdicts = D.verdict(D.forest_score(rows, forest), D.cut_at(D.forest_score(rows, forest), 0.1)).groupBy("prediction").count().collect()
    share = {r["prediction"]: r["count"] for r in verdicts}
    assert abs(share[-1] / (n + 5) - 0.1) < 0.02


def test_rbf_score_is_close_to_the_mean_kernel(spark):
    df, x = points(spark, 300, 3, 7, grid=100)
    rows = scaled(df, 3)
    got = {r["run_id"]: r["sample_score"] for r in D.rbf_score(rows, D.fit_rbf(rows, 3), 3).collect()}
    gamma = 1 / (3 * x.var())
    exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1)).mean(axis=1)
    mine = np.array([got[f"{i:05d}"] for i in range(300)])
    assert np.abs(mine - exact).max() < 0.1 and np.corrcoef(mine, exact)[0, 1] > 0.95


def history(spark, repos=3, days=40):
    rng = np.random.default_rng(8)
    rows = []
    for r in range(repos):
        for d in range(days):
            h, m, low = (int(v) for v in rng.poisson([2, 4, 6]))
            files = int(rng.integers(5, 15))
            rows.append((f"r{r}", f"{d:03d}", d, files, h + m + low, h, m, low, *map(int, rng.poisson([1, 2, 3])), round((h + m + low) / files, 2), "False", "OK", "OK", "OK", "OK", "NORMAL", ""))
    schema = "repo_id string, run_id string, ts long, " + ", ".join(f"{c} long" for c in P.ANOMALY_FEATURES[:-1]) + ", alerts_per_file double, " \
        "ml3_scoring_blocked string, commit_risk_status string, commit_summary_status string, cppcheck_status string, clang_status string, ml3_outcome string, ml3_scoring_block_reason string"
    return spark.createDataFrame(rows, schema)


def test_perturbed_copies_follow_the_recipe(spark):
    h = history(spark, 1)
    both = h.alias("a").join(D.perturbed_copies(h).alias("b"), ["repo_id", "run_id"]).collect()
    names = {c: i for i, c in enumerate(P.ANOMALY_FEATURES)}
    base = {r["run_id"]: r for r in h.collect()}
    changed = {r["run_id"]: r for r in D.perturbed_copies(h).collect()}
    assert len(both) == 40 and names
    for run, b in base.items():
        c = changed[run]
        assert 2 * b["total_alerts"] - 0.5 <= c["total_alerts"] <= 4 * b["total_alerts"] + 0.5
        assert 3 <= c["high_alerts"] - b["high_alerts"] <= 15 and 2 <= c["high_commit_risk"] - b["high_commit_risk"] <= 10
        assert max(1, round(0.35 * b["total_files_scanned"])) <= c["total_files_scanned"] <= max(1, round(0.7 * b["total_files_scanned"]) + 1)
        assert 2 * b["alerts_per_file"] - 0.01 <= c["alerts_per_file"] <= 3 * b["alerts_per_file"] + 0.01
        assert c["medium_alerts"] == b["medium_alerts"]


def test_detect_scores_blocks_and_reports(spark):
    h = history(spark)
    short = history(spark, 1, 5).withColumn("repo_id", F.lit("young"))
    last = h.filter("ts = 39")
    odd = last.filter("repo_id = 'r0'").withColumns({"total_alerts": F.lit(500).cast("long"), "high_alerts": F.lit(300).cast("long")})
    blocked = last.filter("repo_id = 'r1'").withColumns({"ml3_scoring_blocked": F.lit("True"), "ml3_scoring_block_reason": F.lit("why")})
    bad = last.filter("repo_id = 'r2'").withColumn("total_alerts", F.lit(None).cast("long"))
    current = odd.unionByName(blocked).unionByName(bad).unionByName(short.filter("ts = 4"))
    past = h.filter("ts < 39").unionByName(short.filter("ts < 4"))
    got = {r["repo_id"]: r for r in N.detect(past, current, 30).collect()}
    assert got["r0"]["anomaly_status"] == "ANOMALOUS" and got["r0"]["is_anomaly"] and got["r0"]["selected_model"] in (N.FOREST, N.RBF)
    assert (got["r1"]["anomaly_status"], got["r1"]["reason"]) == ("NOT_AVAILABLE", "why")
    assert (got["r2"]["anomaly_status"], got["r2"]["failure_reason"]) == ("FAILED", "CURRENT_METRICS_NON_NUMERIC_FEATURE:total_alerts")
    assert (got["young"]["anomaly_status"], got["young"]["reason"]) == ("NOT_AVAILABLE", "INSUFFICIENT_HISTORY")


def test_detector_evaluation_separates_perturbed_runs(spark):
    table = N.detector_evaluation(N.detector_verdicts(history(spark))).collect()
    assert len(table) == 6 and all(r["normal_examples"] == r["synthetic_anomalies"] == 8 for r in table)
    assert np.mean([r["recall"] for r in table]) > 0.6 and all(0 <= r["pr_auc"] <= 1 for r in table)
    assert sorted(r["selection_rank"] for r in table) == [1, 1, 1, 2, 2, 2]
