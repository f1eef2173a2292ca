"""Per-run rollups: counts, commit summary, run metrics, digests, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions import alerts as A
from gatewright.functions import risk
from gatewright.functions.numbers import round_half_up
from gatewright.operators.ranking import top_per_group

RUN = ["repo_id", "run_id"]


def level_counts(df: DataFrame, column: str, levels: list[str], prefix: str, suffix: str, keys: list[str] | None = None) -> DataFrame:
    """One count per level and run; partial counts are made before the shuffle."""
    return df.groupBy(*(keys or RUN)).agg(
        *[F.count_if(F.col(column) == level).alias(f"{prefix}{level.lower()}{suffix}") for level in levels]
    )


def score_risk(df: DataFrame, params: P.RiskParams | None = None, code: str | None = None) -> DataFrame:
    """Turn ``probability`` into score, confidence, level and (given a code column) terms and reason."""
    p = params or P.RiskParams()
    scored = df.withColumns({"risk_score": risk.risk_score(F.col("probability")), "confidence": risk.confidence(F.col("probability"))})
    level = risk.review_gate(
        risk.risk_level(F.col("risk_score"), p.medium_threshold, p.high_threshold), F.col("confidence"), p.review_confidence
    )
    scored = scored.withColumn("risk_level", level)
    if code is None:
        return scored
    scored = scored.withColumn("top_risky_terms", risk.risky_terms(F.col(code)))
    reason = risk.risk_reason(
        F.col("risk_level"), F.col("top_risky_terms"), F.col("fallback_used"), F.col("confidence"), p.review_confidence
    )
    return scored.withColumn("risk_reason", reason).withColumn("review_confidence_threshold", F.lit(p.review_confidence))


def commit_summary(runs: DataFrame, changed_files: DataFrame, functions: DataFrame) -> DataFrame:
    """One row per run: file and function counts, largest score, leading level and status.

    Runs without changed files, or with files but no function rows, are SKIPPED with their own reason.
    """
    files = changed_files.groupBy(*RUN).agg(F.count(F.lit(1)).alias("total_changed_files"))
    levels = {"high_risk_functions": "HIGH", "review_required_functions": "REVIEW_REQUIRED",
              "medium_risk_functions": "MEDIUM", "low_risk_functions": "LOW"}
    rank = A.lookup(F.col("risk_level"), P.RANK_OF_LEVEL, 0)
    found = functions.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("total_changed_functions"),
        *[F.count_if(F.col("risk_level") == level).alias(name) for name, level in levels.items()],
        F.max("risk_score").alias("max_risk_score"),
        F.max_by("risk_level", rank).alias("commit_risk_level"),
    )
    joined = runs.select(*RUN).distinct().join(files, RUN, "left").join(found, RUN, "left")
    counts = ["total_changed_files", "total_changed_functions", *levels]
    filled = joined.na.fill(0, subset=counts).na.fill(0.0, subset=["max_risk_score"]).na.fill("SKIPPED", subset=["commit_risk_level"])
    # The summary sentences.
    reason = (
        F.when(F.col("total_changed_files") == 0, "No changed C/C++ files detected in the resolved diff range.")
        .when(F.col("total_changed_functions") == 0,
              "Changed C/C++ files were found, but no analyzable functions were extracted.")
        .otherwise("Prediction completed successfully.")
    )
    done = (F.col("total_changed_files") > 0) & (F.col("total_changed_functions") > 0)
    return filled.select(
        *RUN, *counts, "max_risk_score", "commit_risk_level",
        F.when(done, "COMPLETED").otherwise("SKIPPED").alias("status"), reason.alias("reason"),
    )


def run_metrics(runs: DataFrame, alerts: DataFrame, functions: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """The nine anomaly features of each run; absent sides count as zero.

    Files come from the commit summary where the run has one, else from the number of function rows.
    """
    levels = ["HIGH", "MEDIUM", "LOW"]
    a = level_counts(alerts, "priority", levels, "", "_alerts")
    f = functions.groupBy(*RUN).agg(
        *[F.count_if(F.col("risk_level") == x).alias(f"{x.lower()}_commit_risk") for x in levels],
        F.count(F.lit(1)).alias("__rows"),
    )
    facts = runs.join(a, RUN, "left").join(f, RUN, "left")
    files = F.coalesce("__rows", F.lit(0))
    if summary is not None:
        facts = facts.join(summary.select(*RUN, F.col("total_changed_files").alias("__files")), RUN, "left")
        files = F.coalesce("__files", files)
    counts = [f"{x.lower()}{s}" for s in ("_alerts", "_commit_risk") for x in levels]
    facts = facts.na.fill(0, subset=counts).withColumn("total_files_scanned", files.cast("long"))
    total = F.col("high_alerts") + F.col("medium_alerts") + F.col("low_alerts")
    ratio = F.when(
        F.col("total_files_scanned") > 0, round_half_up(total / F.col("total_files_scanned"), 2)
    ).otherwise(F.lit(0.0))
    return facts.withColumn("total_alerts", total).withColumn("alerts_per_file", ratio).select(
        *runs.columns, *P.ANOMALY_FEATURES
    )


def issue_digest(df: DataFrame, level_column: str, text: F.Column, levels: list[str], prefix: str, order: list, n: int = 5) -> DataFrame:
    """The first ``n`` issues of each run and level, joined with `` ; ``, one column per level.

    The top-n filter works before the shuffle, so a run with a third of all rows still sends ``n`` rows per map task.
    """
    rows = df.filter(F.col(level_column).isin(levels)).select(*RUN, F.col(level_column).alias("__level"), text.alias("__text"), *order)
    top = top_per_group(rows, [*RUN, "__level"], [F.col(o) for o in order], n)
    columns = []
    for level in levels:
        listed = F.collect_list(F.when(F.col("__level") == level, F.struct("rn", "__text")))
        texts = F.transform(F.array_sort(listed), lambda x: x["__text"])
        columns.append(F.array_join(texts, " ; ").alias(f"{prefix}{level.lower()}_issues"))
    return top.groupBy(*RUN).agg(*columns)


def alert_digest(alerts: DataFrame, order: list) -> DataFrame:
    text = risk.alert_text(F.col("tool"), F.col("alert_id"), F.col("file"), F.col("line"), F.col("message"))
    return issue_digest(alerts, "priority", text, ["HIGH", "MEDIUM", "LOW"], "alert_", order)


def commit_digest(functions: DataFrame, order: list) -> DataFrame:
    text = risk.commit_text(F.col("file_path"), F.col("risk_score"))
    return issue_digest(functions, "risk_level", text, ["HIGH", "REVIEW_REQUIRED", "MEDIUM", "LOW"], "commit_", order)


def anomaly_defaults(df: DataFrame) -> DataFrame:
    """Status, score and reason of the anomaly report; a run without a report is NOT_AVAILABLE."""
    absent = F.coalesce("anomaly_seen", F.lit(False)) == F.lit(False)
    status = F.coalesce("anomaly_status", F.lit("NOT_AVAILABLE"))
    score_text = F.coalesce(risk.number_text(F.col("anomaly_score")), F.lit(""))
    built = F.concat(F.lit("ML3 pipeline anomaly status: "), status, F.lit(", score: "), score_text)
    reason = F.when(absent, "ML3 anomaly report not available").otherwise(F.coalesce("anomaly_reason", built))
    return df.withColumns({"anomaly_status": status, "anomaly_reason": reason}).drop("anomaly_seen")


def run_facts(runs: DataFrame, alerts: DataFrame, functions: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """Counts per run from all reports, each aggregated before it is joined to the list of runs."""
    a = level_counts(alerts, "priority", ["HIGH", "MEDIUM", "LOW"], "alert_", "_count")
    c = level_counts(functions, "risk_level", ["HIGH", "REVIEW_REQUIRED", "MEDIUM", "LOW"], "commit_", "_count")
    facts = runs.select(*RUN).distinct().join(c, RUN, "left").join(a, RUN, "left").na.fill(0)
    if anomalies is None:
        none = {"anomaly_status": "string", "anomaly_score": "double", "anomaly_reason": "string", "anomaly_seen": "boolean"}
        facts = facts.withColumns({k: F.lit(None).cast(t) for k, t in none.items()})
    else:
        reason = F.col("reason") if "reason" in anomalies.columns else F.lit(None).cast("string")
        report = F.struct("anomaly_status", "anomaly_score", reason.alias("anomaly_reason"))
        # of several reports for a run one whole report, the same whatever the order of tasks
        order = F.col("ord") if "ord" in anomalies.columns else report
        seen = anomalies.groupBy(*RUN).agg(F.min_by(report, order).alias("__a")).select(*RUN, "__a.*", F.lit(True).alias("anomaly_seen"))
        facts = facts.join(seen, RUN, "left")
    return anomaly_defaults(facts)
