"""Commit risk: training on labelled functions and scoring of changed functions for many commits."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.operators import features as X
from gatewright.operators import models as M
from gatewright.operators import rows as O
from gatewright.operators import runs as R
from gatewright.operators.changes import changed_functions
from gatewright.session import cut_lineage


def labelled_split(raw: DataFrame, order: str = "ord") -> DataFrame:
    """One split without incomplete rows, each function text once (first by ``order``)."""
    return O.dedup_first(O.drop_incomplete(raw, ["function_code", "target"]), ["function_code"], order)


def train(functions: DataFrame, names: list[str] | None = None) -> tuple[str, PipelineModel, DataFrame, DataFrame]:
    """Candidates on the train split, choice by recall on valid, one look at test.

    ``functions`` has split, function_code and target.
    """
    rows = functions.withColumn("label", F.col("target").cast("int")).na.fill("", subset=["function_code"])
    rows = cut_lineage(rows, "labelled")
    parts = [rows.filter(F.col("split") == s) for s in ("train", "valid", "test")]
    return M.train_and_select(*parts, "commit_risk", X.fit_code_tfidf(parts[0]), names)


def score_commits(
    runs: DataFrame, sources: DataFrame, diffs: DataFrame, model: PipelineModel, params: P.RiskParams | None = None,
    scan_path: str = ".",
) -> tuple[DataFrame, DataFrame]:
    """(function_risk, commit_summary) of all runs.

    The file filter comes first, so unwanted files are dropped before any text is parsed in Python.
    """
    files = O.changed_source_files(diffs, scan_path).join(sources.select(*R.RUN, "file_path"), [*R.RUN, "file_path"], "left_semi")
    wanted = diffs.join(files, [*R.RUN, "file_path"], "left_semi")
    functions = M.score_functions(model, changed_functions(sources, wanted), params)
    return functions, R.commit_summary(runs, files, functions)
