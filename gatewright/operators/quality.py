"""Checks on schemas, rows, reports and splits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions.numbers import to_number
from gatewright.functions.risk import norm_status, truthy
from gatewright.sources.readers import missing_columns

RUN = ["repo_id", "run_id"]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table itself, or an error that names the missing columns (schema only, no job)."""
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"Required columns missing: {missing}")
    return df


def check_model_schema(model_columns: list[str], columns: list[str]) -> None:
    """Model and runtime must agree on the features and their order."""
    if list(model_columns) != list(columns):
        raise ValueError(f"Model expects a different feature schema. Expected {columns}, model has {model_columns}.")


def report_health(manifest: DataFrame) -> DataFrame:
    """Status of each expected report.

    The manifest has ``found`` (boolean), ``byte_size``, ``columns`` (array, null where the header cannot be read) and
    ``required`` (array). A header without rows is fine; a file without bytes is malformed.
    """
    lacking = F.size(F.array_except("required", F.coalesce("columns", F.array().cast("array<string>")))) > 0
    status = (
        F.when(~F.coalesce("found", F.lit(False)), "MISSING")
        .when(F.col("columns").isNull() | (F.col("byte_size") == 0), "MALFORMED")
        .when(lacking, "SCHEMA_MISMATCH")
        .otherwise("OK")
    )
    return manifest.withColumn("status", status)


def scoring_block(metrics: DataFrame) -> DataFrame:
    """Add ``ml3_scoring_blocked`` and its reason: the bad upstream statuses as sorted ``name=status`` pairs."""
    bad = [
        F.when(F.col(c).isin(P.BAD_STATUSES), F.concat(F.lit(c + "="), F.col(c)))
        for c in sorted(P.UPSTREAM_STATUS_COLUMNS)
    ]
    pairs = F.array_join(F.array_compact(F.array(*bad)), ", ")
    # Fixed value: the block sentence.
    sentence = "ML3 scoring blocked due to missing, malformed, or schema-incompatible upstream reports: "
    return metrics.withColumn("ml3_scoring_blocked", pairs != "").withColumn(
        "ml3_scoring_block_reason", F.when(pairs != "", F.concat(F.lit(sentence), pairs)).otherwise(F.lit(""))
    )


def check_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add ``numeric_failure``: the first feature (in order) that is not a number, else null."""
    failures = [
        F.when(to_number(F.col(c)).isNull(), F.lit(f"CURRENT_METRICS_NON_NUMERIC_FEATURE:{c}"))
        for c in (columns or P.ANOMALY_FEATURES)
    ]
    return df.withColumn("numeric_failure", F.coalesce(*failures))


def check_single_row(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per expected run with ``load_error``: empty for exactly one metrics row."""
    counts = metrics.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    error = (
        F.when(n == 0, "CURRENT_METRICS_FILE_EMPTY")
        .when(n > 1, F.concat(F.lit("CURRENT_METRICS_ROW_COUNT_INVALID:"), n.cast("string")))
        .otherwise(F.lit(""))
    )
    return runs.select(*RUN).distinct().join(counts, RUN, "left").select(*RUN, error.alias("load_error"))


def has_classes(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Whether each group holds every class 0, 1 and 2 (three flags per group, no value lists)."""
    flags = [F.max((F.col(label) == x).cast("int")).alias(f"__c{x}") for x in P.LABELS]
    seen = df.groupBy(*by).agg(*flags)
    total = sum(F.coalesce(f"__c{x}", F.lit(0)) for x in P.LABELS)
    return seen.select(*by, (total == len(P.LABELS)).alias("has_all_classes"))


def split_overlap(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Number of keys shared by each pair of splits, from one pass over the keys."""
    names = ["train", "valid", "test"]
    flags = [F.max((F.col(split) == s).cast("int")).alias(s) for s in names]
    per_key = df.groupBy(*keys).agg(*flags)
    return per_key.agg(
        *[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("long").alias(f"{a}_{b}") for a, b in combinations(names, 2)]
    )


def valid_history(history: DataFrame) -> DataFrame:
    """Rows fit for training: not blocked, no bad upstream status, outcome not FAILED."""
    return history.filter(~_any(_exclusions(history)))


def _exclusions(history: DataFrame) -> dict[str, F.Column]:
    """Named reasons to exclude a row; a row can have several. Columns that do not exist give no reason."""
    reasons = {}
    if "ml3_scoring_blocked" in history.columns:
        reasons["ML3_SCORING_BLOCKED"] = truthy(F.col("ml3_scoring_blocked"))
    for column in P.UPSTREAM_STATUS_COLUMNS:
        if column in history.columns:
            for status in P.BAD_STATUSES:
                reasons[f"{column}:{status}"] = F.coalesce(norm_status(F.col(column)) == status, F.lit(False))
    outcome = next((c for c in ("ml3_outcome", "anomaly_status") if c in history.columns), None)
    if outcome:
        reasons["ML3_OUTCOME_FAILED"] = F.coalesce(norm_status(F.col(outcome)) == "FAILED", F.lit(False))
    return reasons


def _any(reasons: dict[str, F.Column]) -> F.Column:
    flag = F.lit(False)
    for condition in reasons.values():
        flag = flag | condition
    return flag


def exclusion_counts(history: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per exclusion reason (only reasons that occur), then total, valid and excluded rows; one aggregation."""
    by = ["repo_id"] if by is None else by
    reasons = _exclusions(history)
    excluded = _any(reasons)
    names = [*reasons, "TOTAL_ROWS", "VALID_ROWS", "EXCLUDED_ROWS"]
    counts = [F.count_if(c) for c in reasons.values()]
    counts += [F.count(F.lit(1)), F.count_if(~excluded), F.count_if(excluded)]
    wide = history.groupBy(*by).agg(F.array(*[c.cast("long") for c in counts]).alias("__n"))
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("reason"), F.col("__n").alias("rows"))
    long = wide.select(*by, F.explode(pairs).alias("__p")).select(*by, F.col("__p")["reason"].alias("reason"), F.col("__p")["rows"].alias("rows"))
    return long.filter((F.col("rows") > 0) | F.col("reason").isin("TOTAL_ROWS", "VALID_ROWS", "EXCLUDED_ROWS"))


def history_gate(runs: DataFrame, history: DataFrame, min_rows: int = P.DEFAULT_MIN_ROWS) -> DataFrame:
    """Why a repository without a model cannot be scored: too little history, or just not trained."""
    counts = history.groupBy("repo_id").agg(F.count(F.lit(1)).alias("history_rows"))
    rows = F.coalesce("history_rows", F.lit(0))
    reason = F.when(rows < min_rows, "INSUFFICIENT_HISTORY").otherwise("MODEL_NOT_TRAINED")
    return runs.select("repo_id").distinct().join(counts, "repo_id", "left").select(
        "repo_id", rows.alias("history_rows"), reason.alias("reason")
    )


def training_status(history: DataFrame, min_rows: int = P.DEFAULT_MIN_ROWS) -> DataFrame:
    """Per repository: may a detector be trained, and if not, why."""
    # The status sentences.
    none_valid = "No valid historical rows available after ML3 training filters"
    too_few = "Not enough valid historical rows for model training"
    usable = ~_any(_exclusions(history))
    counts = history.groupBy("repo_id").agg(
        F.count_if(usable).alias("rows_available"), F.count(F.lit(1)).alias("total_history_rows")
    )
    n = F.col("rows_available")
    return counts.select(
        "repo_id",
        F.when(n < F.greatest(F.lit(min_rows), F.lit(1)), "SKIPPED").otherwise("READY").alias("status"),
        "rows_available",
        "total_history_rows",
        F.lit(min_rows).alias("min_rows_required"),
        F.when(n == 0, none_valid).when(n < min_rows, too_few).otherwise(F.lit("")).alias("reason"),
    )
