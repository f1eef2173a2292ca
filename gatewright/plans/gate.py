"""The gate: per run BLOCK, REVIEW or PASS with its reason and issue digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.operators import runs as R

# Reason words that turn an unavailable anomaly check into a review.
INPUT_FAULTS = ["MISSING", "MALFORMED", "SCHEMA_MISMATCH", "schema-incompatible", "CURRENT_METRICS_SCHEMA_INCOMPATIBLE"]


def decide(facts: DataFrame) -> DataFrame:
    """Add ``decision`` and ``reason``: the first rule that holds decides."""
    def some(*columns: str) -> F.Column:
        return sum(F.col(c) for c in columns) > 0

    fault = F.lit(False)
    for word in INPUT_FAULTS:
        fault = fault | F.contains(F.col("anomaly_reason"), F.lit(word))
    status = F.col("anomaly_status")
    # Rules in order, with decision and sentence.
    rules = [
        (some("commit_high_count", "alert_high_count"), "BLOCK",
         "High commit risk or high severity security alerts detected"),
        (some("commit_review_required_count"), "REVIEW", "Low-confidence ML1 predictions require manual review"),
        (status == "ANOMALOUS", "REVIEW", "Anomalous CI/CD pipeline behaviour detected by ML3"),
        ((status == "NOT_AVAILABLE") & fault, "REVIEW",
         "ML3 anomaly detection unavailable due to malformed or schema-incompatible upstream input"),
        (status == "FAILED", "REVIEW", "ML3 anomaly detection runtime failed"),
        (some("commit_medium_count", "alert_medium_count"), "REVIEW",
         "Medium commit risk or medium severity security alerts detected"),
        (some("commit_low_count", "alert_low_count"), "PASS", "Only low risk findings detected"),
    ]
    decision = reason = None
    for condition, verdict, sentence in rules:
        decision = F.when(condition, verdict) if decision is None else decision.when(condition, verdict)
        reason = F.when(condition, sentence) if reason is None else reason.when(condition, sentence)
    return facts.withColumn("decision", decision.otherwise("PASS")).withColumn(
        "reason", reason.otherwise("No commit risk, security alerts, or anomaly detected")
    )


def decision_table(
    runs: DataFrame, alerts: DataFrame, functions: DataFrame, anomalies: DataFrame | None = None,
    alert_order: list[str] | None = None, function_order: list[str] | None = None,
) -> DataFrame:
    """Decision, counts, anomaly fields and seven digests per run."""
    facts = decide(R.run_facts(runs, alerts, functions, anomalies))
    commit = R.commit_digest(functions, function_order or ["ord"])
    alert = R.alert_digest(alerts, alert_order or ["tool_order", "ord"])
    return facts.join(commit, R.RUN, "left").join(alert, R.RUN, "left").na.fill(
        "", subset=[c for c in [*commit.columns, *alert.columns] if c.endswith("_issues")]
    )
