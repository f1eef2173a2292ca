"""History to detector to verdict, for all repositories at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions.numbers import round_half_up
from gatewright.operators import detectors as D
from gatewright.operators import evaluation as E
from gatewright.operators import history as H
from gatewright.operators import quality as Q
from gatewright.operators.neighbours import local_outlier_factor
from gatewright.session import cut_lineage

FOREST = "Isolation Forest"
#: The mean RBF kernel to the training rows stands for a one-class SVM; reports keep that name.
RBF = "One-Class SVM"
LOF = "LOF"
CONTAMINATION = 0.1
WIDTH = len(P.ANOMALY_FEATURES)


def trainable(history: DataFrame, min_rows: int = P.DEFAULT_MIN_ROWS) -> DataFrame:
    """Valid rows of repositories that have enough of them."""
    valid = cut_lineage(Q.valid_history(history), "valid")  # counted and read: a history is made once
    enough = valid.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    return valid.join(enough.select("repo_id"), "repo_id", "left_semi")


def fit_detector(name: str, train: DataFrame) -> DataFrame:
    return D.fit_forest(train) if name == FOREST else D.fit_rbf(train, WIDTH)


def score_detector(name: str, rows: DataFrame, model: DataFrame) -> DataFrame:
    return D.forest_score(rows, model) if name == FOREST else D.rbf_score(rows, model, WIDTH)


def fit_and_score(name: str, train: DataFrame, rows: DataFrame) -> DataFrame:
    """Scores of a detector that is not kept."""
    return D.grown_forest_score(rows, train) if name == FOREST else D.rbf_score(rows, D.fit_rbf(train, WIDTH), WIDTH)


def _fit_and_score(name: str, train: DataFrame, rows: DataFrame) -> DataFrame:
    """Verdicts of one detector for scaled rows; the cut comes from its own training scores."""
    keys = ["repo_id", "run_id"]
    extra = [c for c in rows.columns if c not in (*keys, "x")]
    both = train.select(*keys, "x", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in extra], F.lit(True).alias("own"))
    both = both.unionByName(rows.withColumn("own", F.lit(False)))
    scored = cut_lineage(fit_and_score(name, train, both), "detector-scores")
    own, new = scored.filter("own").select(*keys, "sample_score"), scored.filter("not own").drop("own")
    return D.verdict(new, D.cut_at(own, CONTAMINATION)).withColumn("model", F.lit(name))


def detector_verdicts(history: DataFrame, seed: int = P.SEED) -> DataFrame:
    """Both detectors, trained on the older rows, on the holdout rows and their perturbed copies."""
    split = cut_lineage(H.chrono_split(history), "chrono")
    train, holdout = split.filter("split = 'train'").drop("split"), split.filter("split = 'holdout'").drop("split")
    stats = D.scaler(train)
    keep = ["repo_id", "run_id"]
    train_x = cut_lineage(D.scale(train, stats).select(*keep, "x"), "train-x")
    eval_x = cut_lineage(D.scale(D.evaluation_set(holdout, seed), stats).select(*keep, "label", "x"), "eval-x")
    both = _fit_and_score(FOREST, train_x, eval_x).unionByName(_fit_and_score(RBF, train_x, eval_x))
    return cut_lineage(both.drop("x"), "verdicts")


def detector_evaluation(verdicts: DataFrame, seed: int = P.SEED) -> DataFrame:
    """Metrics per repository and detector with rank; the local outlier factor is reported apart, it cannot be deployed."""
    keys = ["repo_id", "model"]
    flagged = verdicts.withColumn("score", -F.col("decision_value")).withColumn(
        "prediction", (F.col("prediction") == -1).cast("int")
    )
    metrics = E.binary_metrics(flagged, keys).drop("accuracy")
    area = E.average_precision(flagged, keys).withColumnRenamed("average_precision", "pr_auc")
    table = metrics.join(area, keys)
    rounded = ["precision", "recall", "f1", "false_positive_rate", "pr_auc"]
    table = table.withColumns({c: round_half_up(F.col(c), 4) for c in rounded}).withColumns({
        "deployment_eligible": F.lit(True),
        "normal_examples": F.col("tn") + F.col("fp"),
        "synthetic_anomalies": F.col("tp") + F.col("fn"),
        "seed": F.lit(seed),
        "exploratory_only": F.lit(False),
    })
    return E.rank_models(table, "anomaly", ["repo_id"])


def lof_in_sample(history: DataFrame, k: int = 10) -> DataFrame:
    """Exploratory: local outlier factor of the training rows, summarised per repository."""
    split = H.chrono_split(history)
    train = split.filter("split = 'train'").drop("split")
    x = D.scale(train, D.scaler(train))
    wide = x.select("repo_id", "run_id", *[F.col("x")[i].alias(f) for i, f in enumerate(P.ANOMALY_FEATURES)])
    scored = local_outlier_factor(wide, P.ANOMALY_FEATURES, k, CONTAMINATION)
    return E.score_range(scored, ["repo_id"], score="lof_score")


def exploratory_rows(usable: DataFrame, evaluation: DataFrame, k: int = 10) -> DataFrame:
    """The local outlier factor's row for each evaluated repository: a summary of its training rows, no metrics and no rank."""
    # Fixed value: why it cannot be chosen.
    reason = "Exploratory only: configured with novelty=False and cannot safely score unseen rows in deployed runtime."
    counts = evaluation.groupBy("repo_id").agg(
        F.first("normal_examples").alias("normal_examples"), F.first("synthetic_anomalies").alias("synthetic_anomalies"), F.first("seed").alias("seed")
    )
    return lof_in_sample(usable, k).join(counts, "repo_id").withColumns({
        "model": F.lit(LOF), "deployment_eligible": F.lit(False), "exploratory_only": F.lit(True), "selected": F.lit(False), "reason": F.lit(reason),
    })


def comparison(history: DataFrame, usable: DataFrame, evaluation: DataFrame, min_rows: int) -> DataFrame:
    """The training report: a row per repository and model where a detector was trained, else one that says why not."""
    status = Q.training_status(history, min_rows)
    rows = evaluation.withColumn("reason", F.lit("")).unionByName(exploratory_rows(usable, evaluation), allowMissingColumns=True)
    trained = rows.join(status.drop("reason", "status"), "repo_id").withColumn("status", F.lit("TRAINED"))
    return trained.unionByName(status.filter("status = 'SKIPPED'"), allowMissingColumns=True)


def score_current(history: DataFrame, current: DataFrame, selected: DataFrame) -> DataFrame:
    """Verdicts of each repository's selected detector, refitted on all valid rows, for its current runs.

    ``selected`` is (repo_id, model).
    """
    stats = D.scaler(history)
    keep = ["repo_id", "run_id"]
    train_x = cut_lineage(D.scale(history, stats).select(*keep, "x").join(selected, "repo_id"), "refit-x")
    rows_x = cut_lineage(D.scale(current, stats).select(*keep, "x").join(selected, "repo_id"), "current-x")
    parts = []
    for name in (FOREST, RBF):
        mine = F.col("model") == name
        parts.append(_fit_and_score(name, train_x.filter(mine).drop("model"), rows_x.filter(mine).drop("model")))
    scored = parts[0].unionByName(parts[1])
    return scored.select(*keep, F.col("model").alias("selected_model"), "prediction", F.col("decision_value").alias("anomaly_score"))


def detect(history: DataFrame, current: DataFrame, min_rows: int = P.DEFAULT_MIN_ROWS) -> DataFrame:
    """Anomaly report rows for current runs: blocked, no model, bad numbers, or scored."""
    usable = cut_lineage(trainable(history, min_rows), "usable")
    selected = detector_evaluation(detector_verdicts(usable)).filter("selected").select("repo_id", "model")
    selected = cut_lineage(selected, "selected")
    checked = Q.check_numeric(current)
    numeric = checked.filter("numeric_failure is null").withColumns({c: F.col(c).cast("double") for c in P.ANOMALY_FEATURES})
    scores = score_current(usable, numeric, selected)
    size = history.groupBy("repo_id").agg(F.count(F.lit(1)).alias("history_rows"))
    rows = (
        checked.join(size, "repo_id", "left")
        .join(selected.select("repo_id", F.lit(True).alias("model_ready")), "repo_id", "left")
        .join(scores, ["repo_id", "run_id"], "left")
        .withColumns({
            "history_rows": F.coalesce("history_rows", F.lit(0)),
            "min_rows_required": F.lit(min_rows),
            "load_error": F.lit(""),
        })
    )
    return H.anomaly_report(rows)
