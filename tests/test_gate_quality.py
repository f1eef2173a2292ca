"""Gate rules, digests, summaries, checks and history."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gatewright.operators import history as H
from gatewright.operators import quality as Q
from gatewright.operators import rows as O
from gatewright.operators import runs as R
from gatewright.plans import gate as G

ALERT = "repo_id string, run_id string, ord int, priority string, tool string, tool_order int, file string, line int, alert_id string, message string"
RISK = "repo_id string, run_id string, ord int, risk_level string, file_path string, risk_score double"
ANOMALY = "repo_id string, run_id string, anomaly_status string, anomaly_score double, reason string"


def alert(run, i, priority, tool="cppcheck", line=10):
    return ("r", run, i, priority, tool, 0 if tool == "cppcheck" else 1, f"src/file{i}.c", line, f"A{i}", f"msg {i}")


def risk(run, i, level):
    return ("r", run, i, level, f"src/file{i}.py", 0.1 * i)


def decisions(spark, cases, missing_reason=False):
    runs = spark.createDataFrame([("r", run) for run in cases], "repo_id string, run_id string")
    alerts = spark.createDataFrame([alert(run, i, p) for run, c in cases.items() for i, p in enumerate(c.get("alerts", []))], ALERT)
    risks = spark.createDataFrame([risk(run, i, x) for run, c in cases.items() for i, x in enumerate(c.get("risks", []))], RISK)
    reports = spark.createDataFrame([("r", run, *c["anomaly"]) for run, c in cases.items() if "anomaly" in c], ANOMALY)
    if missing_reason:
        reports = reports.drop("reason")
    return {r["run_id"]: r for r in G.decision_table(runs, alerts, risks, reports).collect()}


def test_rules_in_order(spark):
    got = decisions(spark, {
        "empty": {}, "low": {"risks": ["LOW"], "alerts": ["LOW"]}, "high alert": {"alerts": ["HIGH", "LOW"]}, "high risk": {"risks": ["HIGH"]},
        "review": {"risks": ["REVIEW_REQUIRED", "MEDIUM"]}, "medium": {"alerts": ["MEDIUM"]},
        "anomalous": {"anomaly": ("ANOMALOUS", 0.9, "odd"), "alerts": ["MEDIUM"]}, "failed": {"anomaly": ("FAILED", None, "x")},
        "missing": {"anomaly": ("NOT_AVAILABLE", None, "MISSING upstream metric columns")},
        "schema": {"anomaly": ("NOT_AVAILABLE", None, "is schema-incompatible")}, "lower case": {"anomaly": ("NOT_AVAILABLE", None, "missing")},
        "normal": {"anomaly": ("NORMAL", -0.1, "fine")}, "block first": {"risks": ["HIGH", "REVIEW_REQUIRED"], "anomaly": ("ANOMALOUS", 1.0, "x")},
    })
    assert {k: r["decision"] for k, r in got.items()} == {
        "empty": "PASS", "low": "PASS", "high alert": "BLOCK", "high risk": "BLOCK", "review": "REVIEW", "medium": "REVIEW", "anomalous": "REVIEW",
        "failed": "REVIEW", "missing": "REVIEW", "schema": "REVIEW", "lower case": "PASS", "normal": "PASS", "block first": "BLOCK",
    }
    assert got["empty"]["reason"] == "No commit risk, security alerts, or anomaly detected"
    assert got["low"]["reason"] == "Only low risk findings detected"
    assert got["anomalous"]["reason"].startswith("Anomalous CI/CD")
    assert (got["empty"]["anomaly_status"], got["empty"]["anomaly_reason"]) == ("NOT_AVAILABLE", "ML3 anomaly report not available")
    assert got["empty"]["alert_high_issues"] == "" and got["empty"]["commit_high_count"] == 0


def test_reason_is_built_without_the_column(spark):
    got = decisions(spark, {"a": {"anomaly": ("ANOMALOUS", 0.5, "")}}, missing_reason=True)
    assert got["a"]["anomaly_reason"] == "ML3 pipeline anomaly status: ANOMALOUS, score: 0.5"


def test_digests_hold_five_in_order(spark):
    rows = [alert("1", i, "HIGH", "clang" if i < 3 else "cppcheck", None if i == 4 else 10 * i) for i in range(9)]
    digest = R.alert_digest(spark.createDataFrame(rows, ALERT), ["tool_order", "ord"]).first()["alert_high_issues"].split(" ; ")
    assert digest == ["cppcheck | A3 | src/file3.c:30 | msg 3", "cppcheck | A4 | src/file4.c | msg 4", "cppcheck | A5 | src/file5.c:50 | msg 5",
                      "cppcheck | A6 | src/file6.c:60 | msg 6", "cppcheck | A7 | src/file7.c:70 | msg 7"]


def test_missing_columns_raise(spark):
    with pytest.raises(Exception, match="risk_level"):
        R.commit_digest(spark.createDataFrame([("r", "1", 1)], "repo_id string, run_id string, ord int"), ["ord"]).collect()
    with pytest.raises(ValueError, match="priority"):
        Q.require_columns(spark.range(1), ["priority"])
    with pytest.raises(ValueError, match="feature schema"):
        Q.check_model_schema(["a", "b"], ["b", "a"])


def test_commit_summary_levels(spark):
    cases = {"none": [], "low": ["LOW"] * 3, "medium": ["LOW", "MEDIUM", "LOW"], "high": ["LOW", "HIGH"], "review": ["MEDIUM", "REVIEW_REQUIRED"],
             "both": ["REVIEW_REQUIRED", "HIGH"]}
    runs = spark.createDataFrame([("r", k) for k in [*cases, "no files"]], "repo_id string, run_id string")
    files = spark.createDataFrame([("r", k, "a.c") for k in cases], "repo_id string, run_id string, file_path string")
    risks = spark.createDataFrame([risk(k, i, x) for k, v in cases.items() for i, x in enumerate(v)], RISK)
    got = {r["run_id"]: r for r in R.commit_summary(runs, files, risks).collect()}
    levels = {k: r["commit_risk_level"] for k, r in got.items()}
    assert levels == {"none": "SKIPPED", "low": "LOW", "medium": "MEDIUM", "high": "HIGH", "review": "REVIEW_REQUIRED", "both": "HIGH", "no files": "SKIPPED"}
    assert got["none"]["reason"].startswith("Changed C/C++ files were found") and got["no files"]["reason"].startswith("No changed C/C++")
    assert (got["low"]["status"], got["none"]["status"], got["low"]["max_risk_score"]) == ("COMPLETED", "SKIPPED", 0.2)


def test_report_health_and_block(spark):
    rows = [("a", True, 10, ["priority"], ["priority"]), ("b", False, None, None, ["priority"]), ("c", True, 0, None, ["priority"]),
            ("d", True, 5, ["x"], ["priority"]), ("e", True, 5, ["x", "priority"], ["priority"])]
    df = spark.createDataFrame(rows, "name string, found boolean, byte_size int, columns array<string>, required array<string>")
    assert {r["name"]: r["status"] for r in Q.report_health(df).collect()} == {"a": "OK", "b": "MISSING", "c": "MALFORMED", "d": "SCHEMA_MISMATCH", "e": "OK"}
    m = spark.createDataFrame([("OK", "MISSING", "OK", "SCHEMA_MISMATCH"), ("OK", "OK", "NOT_APPLICABLE", "OK")],
                              "commit_risk_status string, commit_summary_status string, cppcheck_status string, clang_status string")
    got = Q.scoring_block(m).collect()
    assert got[0]["ml3_scoring_block_reason"].endswith("upstream reports: clang_status=SCHEMA_MISMATCH, commit_summary_status=MISSING")
    assert not got[1]["ml3_scoring_blocked"] and got[1]["ml3_scoring_block_reason"] == ""


def test_history_filter_counts_every_reason(spark):
    rows = [("r", str(i), *c) for i, c in enumerate([
        ("False", "OK", "OK", "OK", "OK", "NORMAL"), ("True", "missing ", "OK", "OK", "OK", "failed"), ("yes", "OK", "OK", "OK", "OK", "NORMAL"),
        ("1", "OK", "OK", "OK", "OK", "NORMAL"), ("0", "OK", "Malformed", "OK", "SCHEMA_MISMATCH", "NORMAL"), (None, "OK", "OK", "OK", "OK", None)])]
    h = spark.createDataFrame(rows, "repo_id string, run_id string, ml3_scoring_blocked string, commit_risk_status string, commit_summary_status string, "
                                    "cppcheck_status string, clang_status string, ml3_outcome string")
    assert sorted(r["run_id"] for r in Q.valid_history(h).collect()) == ["0", "5"]
    got = {r["reason"]: r["rows"] for r in Q.exclusion_counts(h).collect()}
    assert got == {"ML3_SCORING_BLOCKED": 3, "commit_risk_status:MISSING": 1, "commit_summary_status:MALFORMED": 1, "clang_status:SCHEMA_MISMATCH": 1,
                   "ML3_OUTCOME_FAILED": 1, "TOTAL_ROWS": 6, "VALID_ROWS": 2, "EXCLUDED_ROWS": 4}
    assert Q.training_status(h, 3).first()["status"] == "SKIPPED" and Q.training_status(h, 2).first()["status"] == "READY"


def test_chronological_holdout_is_exact_for_one_hot_repository(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 37)).alias("repo_id"),
                                    F.col("id").cast("string").alias("run_id"), (F.col("id") * 7919 % 5000).alias("ts"))
    got = H.chrono_split(rows).groupBy("repo_id").agg(
        F.count_if(F.col("split") == "holdout").alias("h"), F.count("*").alias("n"),
        F.min(F.when(F.col("split") == "holdout", F.col("ts"))).alias("first"), F.max(F.when(F.col("split") == "train", F.col("ts"))).alias("last")).collect()
    assert len(got) == 38
    for r in got:
        assert r["h"] == min(max(1, round(0.2 * r["n"])), r["n"] - 1) and r["first"] > r["last"]


def test_prior_baseline_never_sees_itself(spark):
    rows = spark.createDataFrame([("r", str(i), i, float(v)) for i, v in enumerate([1, 3, 5, 100])], "repo_id string, run_id string, ts int, x double")
    got = {r["run_id"]: (r["prior_runs"], r["x_prior_mean"], r["x_prior_std"]) for r in H.prior_baseline(rows, ["x"]).collect()}
    assert got == {"0": (0, None, None), "1": (1, 1.0, 0.0), "2": (2, 2.0, 1.0), "3": (3, 3.0, 1.632993)}


def test_fingerprint_ignores_read_order(spark):
    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "ord int, x double")
    a = H.dataset_fingerprint(rows, ["x"], "ord").first()["fingerprint"]
    assert a == H.dataset_fingerprint(rows.orderBy(F.desc("ord")).repartition(7), ["x"], "ord").first()["fingerprint"]
    assert a != H.dataset_fingerprint(rows.withColumn("x", F.col("x") + 1), ["x"], "ord").first()["fingerprint"]


def test_dedup_keeps_first_and_treats_nulls_as_equal(spark):
    rows = spark.createDataFrame([("a", None, 3), ("a", None, 1), ("b", "x", 2), (None, None, 5), (None, None, 4)], "k string, j string, ord int")
    got = sorted((r["k"] or "", r["ord"]) for r in O.dedup_first(rows, ["k", "j"]).collect())
    assert got == [("", 4), ("a", 1), ("b", 2)]
    other = spark.createDataFrame([("a", None)], "k string, j string")
    assert O.difference(rows, other, ["k", "j"]).count() == 3
