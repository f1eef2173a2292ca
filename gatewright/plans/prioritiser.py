"""Alert prioritisers: training tables, annotation of analyzer alerts, training."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions import alerts as A
from gatewright.functions import paths, text
from gatewright.operators import features as X
from gatewright.operators import models as M
from gatewright.operators import quality as Q
from gatewright.operators import rows as O
from gatewright.operators import splits as S
from gatewright.operators.changes import enclosing_function
from gatewright.operators.matching import match_diagnostic, match_report, match_source
from gatewright.operators.spans import typed_function_spans
from gatewright.session import cut_lineage

ANNOTATION = [
    "annotation_id", "tool", "source_file", "line", "alert_id", "cwe", "severity", "message", "juliet_case_id",
    "juliet_cwe_family", "source_function", "is_bad_path", "is_good_path", "ground_truth_status", "raw_report_path",
    "manual_priority", "annotation_reason", "has_plist_match", "ground_truth_origin",
]


def cppcheck_training(actionable: DataFrame, non_actionable: DataFrame, order: str = "ord") -> DataFrame:
    """Both warning sets as one table without exact repeats."""
    return O.dedup_first(O.union_tables(actionable, non_actionable), P.ALERT_KEY_CPPCHECK, order)


def annotate(alerts: DataFrame, index: DataFrame, diagnostics: DataFrame, sources: DataFrame) -> DataFrame:
    """Analyzer alerts with function, ground truth and its origin.

    ``alerts``: repo_id, ord and the console-alert columns; ``index`` and ``diagnostics``: the reports' files and
    diagnostics with repo_id; ``sources``: repo_id, source_file, content.
    """
    reported = match_report(O.drop_notes(alerts), index)
    found = match_diagnostic(match_source(reported, index), diagnostics)
    spans = typed_function_spans(sources, ["repo_id", "source_file"])
    placed = enclosing_function(found, spans, ["repo_id", "source_file"])
    status, origin = text.ground_truth(F.col("source_function"), F.col("enclosing_function"))
    parts = [F.col(c) for c in ("source_file", "line", "alert_id", "cwe", "severity", "message")]
    rows = placed.withColumns({
        "ground_truth_status": status,
        "ground_truth_origin": origin,
        "annotation_id": text.annotation_id(*parts),
        "juliet_case_id": paths.case_id(paths.stem(F.col("source_file"))),
        "juliet_cwe_family": paths.cwe_family(F.col("source_file")),
        "manual_priority": F.lit(""),
        "annotation_reason": F.lit(""),
    }).withColumns({
        "is_bad_path": (F.col("ground_truth_status") == "bad").cast("int"),
        "is_good_path": (F.col("ground_truth_status") == "good").cast("int"),
    })
    return O.dedup_first(rows.select("repo_id", "ord", *ANNOTATION), ["repo_id", *P.ANNOTATION_KEY])


def clang_training(annotated: DataFrame) -> DataFrame:
    """Annotated alerts with priority, label and features."""
    Q.require_columns(annotated, ["message", "alert_id", "severity", "cwe", "juliet_cwe_family", "ground_truth_status"])
    rated = annotated.withColumn("priority", A.priority_b(F.col("ground_truth_status"), F.col("juliet_cwe_family")))
    rated = rated.withColumn("label", A.label_of(F.col("priority")))
    return O.alert_features(O.fill_text(rated, {c: "" for c in ("message", "alert_id", "severity", "cwe")}), "clang")


def clang_model_rows(training: DataFrame, order: str = "ord") -> DataFrame:
    """Labelled rows once per key; rows without a known label are left out."""
    return O.dedup_first(O.known_labels(training), P.ALERT_KEY_CLANG, order)


def train(
    rows: DataFrame, variant: str, group: str, trials: int | None = None, names: list[str] | None = None,
) -> tuple[str, PipelineModel, DataFrame, DataFrame]:
    """Grouped split (best of the searched seeds), candidates, choice on valid, one look at test."""
    cppcheck = variant == "cppcheck"
    key = P.ALERT_KEY_CPPCHECK if cppcheck else P.ALERT_KEY_CLANG
    table = cut_lineage(O.fill_text(rows, {"cwe": "0", "message": "", "alert_id": "", "severity": ""}), "alerts")
    split = S.best_split(
        table, group, trials=trials or (120 if cppcheck else 500), policy="divergence" if cppcheck else "first"
    )
    split = cut_lineage(split, "alert-splits")
    leaks = Q.split_overlap(split, [group]).unionByName(Q.split_overlap(split, key)).collect()  # two rows
    if any(value for row in leaks for value in row):
        raise ValueError("Rows or groups are shared between the splits.")
    parts = [split.filter(F.col("split") == s) for s in ("train", "valid", "test")]
    return M.train_and_select(*parts, variant, M.feature_model(parts[0], variant, X.MESSAGE_TERMS), names)
