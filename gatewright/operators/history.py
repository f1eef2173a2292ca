"""Run history: identifiers, fingerprints, chronological holdout, prior-only baselines, anomaly report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions.numbers import round_half_even_int, round_half_up
from gatewright.functions.risk import truthy
from gatewright.operators.ranking import running_before
from gatewright.session import cut_lineage


def chrono_split(history: DataFrame, ratio: float = 0.2, time: str = "ts", tie: str = "run_id") -> DataFrame:
    """Add ``split``: per repository the last ``max(1, round(ratio * n))`` rows (never all) are the holdout."""
    placed = running_before(history, ["repo_id"], [F.col(time), F.col(tie)], {"n": F.lit(1)})
    n = F.col("n_total")
    size = F.least(F.greatest(F.lit(1), round_half_even_int(n * F.lit(ratio))), n - 1)
    size = F.greatest(size, F.lit(1))
    split = F.when(F.col("n_before") >= n - size, "holdout").otherwise("train")
    return placed.withColumn("split", split).drop("n_before", "n_total")


def prior_baseline(history: DataFrame, features: list[str] | None = None, time: str = "ts", tie: str = "run_id") -> DataFrame:
    """Count, mean and population deviation of each feature over strictly earlier runs of the repository."""
    features = features or P.ANOMALY_FEATURES
    rows = cut_lineage(history, "history")
    # squares of differences from a number near the repository's mean: those of large counts would cancel
    centres = rows.groupBy(F.col("repo_id").alias("__repo")).agg(*[F.coalesce(F.floor(F.avg(f)), F.lit(0)).cast("double").alias(f"__c_{f}") for f in features])
    rows = rows.join(centres, rows["repo_id"].eqNullSafe(centres["__repo"])).drop("__repo")
    values = {"n": F.lit(1)}
    for f in features:
        off = F.col(f).cast("double") - F.col(f"__c_{f}")
        values |= {f"{f}_s": off, f"{f}_q": off * off}
    placed = running_before(rows, ["repo_id"], [F.col(time), F.col(tie)], values)
    n = F.col("n_before")
    columns = []
    for f in features:
        off = F.try_divide(F.col(f"{f}_s_before"), n)
        variance = F.try_divide(F.col(f"{f}_q_before"), n) - off * off
        spread = F.when(n > 0, F.sqrt(F.greatest(variance, F.lit(0.0))))
        columns += [round_half_up(off + F.col(f"__c_{f}"), 6).alias(f"{f}_prior_mean"), round_half_up(spread, 6).alias(f"{f}_prior_std")]
    return placed.select(*history.columns, n.alias("prior_runs"), *columns)


def time_range(history: DataFrame, time: str = "ts") -> DataFrame:
    return history.groupBy("repo_id").agg(
        F.min(time).alias("history_timestamp_min"), F.max(time).alias("history_timestamp_max")
    )


def dataset_fingerprint(df: DataFrame, columns: list[str], order: str, by: list[str] | None = None) -> DataFrame:
    """sha256 over count and bit sums of row hashes (values and row position); independent of the read order.

    Each row hash gives two 48-bit numbers that are summed, so map tasks combine and no list of hashes is collected.
    """
    text = F.md5(F.concat_ws("|", F.col(order).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]))

    def part(start: int) -> F.Column:
        return F.sum(F.conv(F.substring(text, start, 12), 16, 10).cast("decimal(38,0)"))

    sums = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(13).alias("b"))
    joined = F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return sums.select(*(by or []), F.col("n").alias("rows"), F.sha2(joined, 256).alias("fingerprint"))


def anomaly_report(runs: DataFrame) -> DataFrame:
    """Anomaly status, reason and failure of each run; the first condition that holds decides.

    Input columns: load_error, ml3_scoring_blocked, ml3_scoring_block_reason, model_ready, history_rows,
    min_rows_required, numeric_failure, prediction (-1 / 1), anomaly_score, selected_model; schema_failure if there is such a check.
    """
    loaded = F.coalesce("load_error", F.lit("")) == ""
    blocked = truthy(F.col("ml3_scoring_blocked"))
    ready = F.coalesce("model_ready", F.lit(False))
    number_fault = F.col("numeric_failure").isNotNull()
    schema_fault = F.col("schema_failure") if "schema_failure" in runs.columns else F.lit(None).cast("string")
    # The report sentences.
    cases = [
        (~loaded, "FAILED", F.lit("ML3 current metrics unavailable or invalid"), F.col("load_error")),
        (blocked, "NOT_AVAILABLE",
         F.coalesce(F.nullif(F.trim("ml3_scoring_block_reason"), F.lit("")), F.lit("ML3_SCORING_BLOCKED")), F.lit("")),
        (~ready, "NOT_AVAILABLE",
         F.when(F.col("history_rows") < F.col("min_rows_required"), "INSUFFICIENT_HISTORY").otherwise("MODEL_NOT_TRAINED"),
         F.lit("")),
        (schema_fault.isNotNull(), "FAILED", F.lit("Current metrics schema is incompatible with trained model"), schema_fault),
        (number_fault, "FAILED", F.lit("Current metrics contain non-numeric feature values"), F.col("numeric_failure")),
        (F.col("prediction").isNull(), "FAILED", F.lit("ML3 inference failed"), F.lit("INFERENCE_FAILED")),
        (F.col("prediction") == -1, "ANOMALOUS", F.lit("Scored using trained ML3 anomaly model"), F.lit("")),
    ]
    status = reason = failure = None
    for condition, name, why, fault in cases:
        status = F.when(condition, name) if status is None else status.when(condition, name)
        reason = F.when(condition, why) if reason is None else reason.when(condition, why)
        failure = F.when(condition, fault) if failure is None else failure.when(condition, fault)
    rows = runs.withColumns({
        "anomaly_status": status.otherwise("NORMAL"),
        "reason": reason.otherwise("Scored using trained ML3 anomaly model"),
        "failure_reason": failure.otherwise(F.lit("")),
    })
    scored = F.col("anomaly_status").isin("NORMAL", "ANOMALOUS")
    return rows.withColumns({
        "is_anomaly": F.when(scored, F.col("anomaly_status") == "ANOMALOUS"),
        "anomaly_score": F.when(scored, F.col("anomaly_score")),
        "selected_model": F.when(scored, F.col("selected_model")).otherwise(F.lit("")),
        "append_to_history": scored | (F.col("anomaly_status") == "NOT_AVAILABLE"),
    })
