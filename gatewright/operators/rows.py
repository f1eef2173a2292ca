"""Projection, filters, de-duplication, set operations and sorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions import alerts as A
from gatewright.functions import paths
from gatewright.functions.numbers import to_number


# ---- projections -------------------------------------------------------------------------------------------------
def to_labelled_function(df: DataFrame, split: Column, mapping: dict[str, Column]) -> DataFrame:
    """Canonical labelled-function columns: missing text columns become empty, a missing target 0."""
    defaults = {c: F.lit("") for c in ("project", "commit_id", "cve", "cwe", "function_code")}
    defaults["target"] = F.lit(0).cast("long")
    return df.select(split.alias("split"), *[mapping.get(c, d).alias(c) for c, d in defaults.items()])


def warning_to_alert(df: DataFrame, is_actionable: bool) -> DataFrame:
    """Warning records (toolName, filePath, …) as alert-training rows with features, priority and label."""
    base = df.select(
        F.col("toolName").alias("tool"),
        F.col("filePath").alias("file"),
        to_number(F.col("lineNumber")).alias("line"),
        F.col("warningType").alias("alert_id"),
        F.col("cwe").cast("string").alias("cwe"),
        F.col("warningSeverity").alias("severity"),
        F.col("warningMessage").alias("message"),
        F.lit(is_actionable).alias("__act"),
        *[c for c in df.columns if c == "ord"],
    )
    rated = base.withColumn("is_actionable", F.col("__act").cast("int")).withColumn(
        "priority", A.priority_a(F.col("__act"), F.col("severity"))
    )
    return alert_features(rated.withColumn("label", A.label_of(F.col("priority"))), "cppcheck").drop("__act")


def alert_features(df: DataFrame, variant: str, scoring: bool = False) -> DataFrame:
    """Add severity score, cwe flag, keyword flags and tool flag; one code path for training and scoring."""
    cppcheck = variant == "cppcheck"
    words = P.KEYWORDS_CPPCHECK if cppcheck else P.KEYWORDS_CLANG
    score = A.severity_score_a if cppcheck else A.severity_score_b
    one = F.lit(1)
    tool = {"is_cppcheck": one if scoring else A.tool_flag(F.col("tool"), "cppcheck")} if cppcheck else {"is_clang": one}
    return df.withColumns(
        {
            "severity_score": score(F.col("severity")),
            "has_cwe": A.has_value(F.col("cwe")),
            **{name: A.keyword_flag(F.col("message"), terms) for name, terms in words.items()},
            **tool,
        }
    )


def fill_text(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.na.fill(defaults)


def ensure_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Feature columns that are absent become 0, and nulls in present ones become 0."""
    absent = {c: F.lit(0) for c in columns if c not in df.columns}
    return df.withColumns(absent).na.fill(0, subset=columns) if absent else df.na.fill(0, subset=columns)


def select_features(df: DataFrame, variant: str, extra: list[str] | None = None) -> DataFrame:
    """Model features in their fixed order; identity and label columns stay out."""
    return df.select(*(P.FEATURES_CPPCHECK if variant == "cppcheck" else P.FEATURES_CLANG), *(extra or []))


# ---- filters -----------------------------------------------------------------------------------------------------
def changed_source_files(df: DataFrame, scan_path: str = ".", keys: tuple[str, ...] = ("repo_id", "run_id")) -> DataFrame:
    """Distinct changed C/C++ files outside excluded folders and under the scan path."""
    path = F.trim(F.col("file_path"))
    kept = df.withColumn("file_path", path).filter(
        paths.is_source_file(path) & ~paths.in_excluded_folder(path) & paths.under_scan_path(path, scan_path)
    )
    return kept.select(*keys, "file_path").distinct()


def drop_ignored(df: DataFrame, ids: list[str] | None = None) -> DataFrame:
    return df.filter(~F.coalesce(F.col("alert_id"), F.lit("")).isin(ids or P.IGNORED_ALERT_IDS))


def drop_notes(df: DataFrame) -> DataFrame:
    return df.filter(F.col("severity") != "note")


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def known_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.coalesce(F.col(label).isin(P.LABELS), F.lit(False)))


def selected_families(df: DataFrame, families: list[str] | None = None, path: str = "source_file") -> DataFrame:
    wanted = families or [P.MEDIUM_FAMILY, *P.HIGH_FAMILIES]
    return df.withColumn("cwe_folder", paths.cwe_family(F.col(path))).filter(F.col("cwe_folder").isin(wanted))


# ---- de-duplication and sets -------------------------------------------------------------------------------------
def dedup_first(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """First row per key in ``order``; nulls in keys are equal.

    ``min_by`` is a partial aggregate: each map task sends one row per key, so a key with a third of all rows is safe.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__first"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in df.columns])


def union_tables(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def overlap_size(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Number of distinct rows that both tables hold."""
    both = a.select(*columns).intersect(b.select(*columns))
    return both.agg(F.count(F.lit(1)).alias("overlap"))


def difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``."""
    condition = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])
    return a.alias("a").join(b.select(*columns).alias("b"), condition, "left_anti")


# ---- sorts -------------------------------------------------------------------------------------------------------
def rank_alerts(df: DataFrame) -> DataFrame:
    """Alerts from HIGH to LOW; file, line and id fix the order of ties."""
    return df.orderBy(A.priority_rank(F.col("priority")).desc_nulls_last(), "file", "line", "alert_id", "message")


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def sample_head(df: DataFrame, n: int, order: list) -> DataFrame:
    return df.orderBy(*order).limit(n)


def best_row(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(1)
