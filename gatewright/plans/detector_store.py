"""Detectors that are trained once, kept by repository and version, and loaded to score runs."""

from __future__ import annotations

import platform

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.operators import detectors as D
from gatewright.operators import history as H
from gatewright.operators import quality as Q
from gatewright.plans import anomaly as N
from gatewright.session import cut_lineage
from gatewright.sources.keyed_store import KeyedStore

FOREST_TYPE = "struct<feature:array<int>,threshold:array<double>,child:array<int>,length:array<double>,trees:int,sample_size:int>"
RBF_TYPE = "struct<gamma:double,mean_map:array<double>>"
#: The order in which detectors are compared; time is not measured, so equal ones keep the order of their names.
POLICY = ["anomaly_f1_desc", "anomaly_recall_desc", "false_positive_rate_asc", "model_name_asc"]
METRICS = ["precision", "recall", "f1", "false_positive_rate", "pr_auc"]


def detector_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, ("repo_id",))


def fingerprints(usable: DataFrame) -> DataFrame:
    """(repo_id, fingerprint) of the rows that a repository's detector is trained on."""
    return H.dataset_fingerprint(usable, P.ANOMALY_FEATURES, "run_id", ["repo_id"]).select("repo_id", "fingerprint")


def fitted(usable: DataFrame, selected: DataFrame) -> DataFrame:
    """(repo_id, model, features, mean, dev, forest, rbf, cut): each repository's selected detector, fitted on all its valid rows.

    ``selected`` is (repo_id, model). One of ``forest`` and ``rbf`` is null.
    """
    stats = D.scaler(usable)
    arrays = stats.select(
        "repo_id",
        F.array(*[F.lit(c) for c in P.ANOMALY_FEATURES]).alias("features"),
        F.array(*[F.col(f"{c}_mean").cast("double") for c in P.ANOMALY_FEATURES]).alias("mean"),
        F.array(*[F.col(f"{c}_dev").cast("double") for c in P.ANOMALY_FEATURES]).alias("dev"),
    )
    x = cut_lineage(D.scale(usable, stats).select("repo_id", "run_id", "x").join(selected, "repo_id"), "fit-x")
    parts, cuts = [], []
    for name in (N.FOREST, N.RBF):
        own = x.filter(F.col("model") == name).drop("model")
        model = N.fit_detector(name, own)
        cuts.append(D.cut_at(cut_lineage(N.fit_and_score(name, own, own), "own-scores"), N.CONTAMINATION))
        held = F.struct(*[c for c in model.columns if c != "repo_id"])
        forest = held.cast(FOREST_TYPE) if name == N.FOREST else F.lit(None).cast(FOREST_TYPE)
        rbf = held.cast(RBF_TYPE) if name == N.RBF else F.lit(None).cast(RBF_TYPE)
        parts.append(model.select("repo_id", F.lit(name).alias("model"), forest.alias("forest"), rbf.alias("rbf")))
    # forests are large: they are joined once, all by one key
    return parts[0].unionByName(parts[1]).join(cut_lineage(cuts[0].unionByName(cuts[1]).join(arrays, "repo_id"), "fitted"), "repo_id")


def metadata(history: DataFrame, usable: DataFrame, evaluation: DataFrame, prints: DataFrame, min_rows: int, seed: int = P.SEED) -> DataFrame:
    """One row per repository of ``prints``: what its detector was chosen by, made of and made with."""
    chosen = evaluation.filter("selected").select(
        "repo_id", F.col("model").alias("selected_model"), F.struct(*METRICS).alias("selection_metrics"), "normal_examples", "synthetic_anomalies"
    )
    counts = Q.exclusion_counts(history).groupBy("repo_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "rows")))).alias("counts")
    )
    totals = ("TOTAL_ROWS", "VALID_ROWS", "EXCLUDED_ROWS")
    number = [F.col("counts")[c].alias(n) for c, n in zip(totals, ("total_history_rows", "valid_training_rows", "excluded_history_rows"))]
    reasons = F.map_filter("counts", lambda k, _: ~k.isin(*totals)).alias("exclusion_reasons")
    times = H.time_range(usable)
    recipe = F.create_map(*[x for k, v in P.PERTURBATION.items() for x in (F.lit(k), F.array(*[F.lit(float(b)) for b in v]))])
    settings = {
        N.FOREST: {"trees": D.TREES, "sample": D.SAMPLE, "contamination": N.CONTAMINATION},
        N.RBF: {"fourier_components": D.FOURIER, "contamination": N.CONTAMINATION},
        N.LOF: {"neighbours": 10, "contamination": N.CONTAMINATION},
    }
    hyper = F.create_map(*[x for k, v in settings.items() for x in (F.lit(k), F.create_map(*[y for a, b in v.items() for y in (F.lit(a), F.lit(float(b)))]))])
    fixed = {
        "selection_policy": F.array(*[F.lit(p) for p in POLICY]),
        "model_hyperparameters": hyper,
        "feature_columns": F.array(*[F.lit(c) for c in P.ANOMALY_FEATURES]),
        "minimum_required_rows": F.lit(min_rows),
        "random_seed": F.lit(seed),
        "synthetic_anomaly_generation_method": F.struct(F.lit("deterministic_perturbation").alias("name"), F.lit(seed).alias("seed"), recipe.alias("recipe")),
        "python_version": F.lit(platform.python_version()),
        "spark_version": F.lit(pyspark.__version__),
        "training_timestamp": F.current_timestamp(),
    }
    rows = prints.withColumnRenamed("fingerprint", "training_data_hash").join(chosen, "repo_id").join(counts.select("repo_id", *number, reasons), "repo_id")
    return rows.join(times, "repo_id").withColumns(fixed)


def train_detectors(history: DataFrame, path: str, min_rows: int = P.DEFAULT_MIN_ROWS, seed: int = P.SEED) -> DataFrame:
    """Train what has changed and make it the store's current version; the answer is the training report of these repositories.

    A repository whose valid rows have the fingerprint of its stored detector is neither evaluated nor fitted again; one that has
    too few rows keeps the detector it has. Without changes no version is made and the report holds only repositories that were skipped.
    """
    store = detector_store(history.sparkSession, path)
    usable = cut_lineage(N.trainable(history, min_rows), "usable")
    prints = cut_lineage(store.changed(fingerprints(usable)), "changed-histories")
    usable = usable.join(prints.select("repo_id"), "repo_id", "left_semi")
    evaluation = cut_lineage(N.detector_evaluation(N.detector_verdicts(usable, seed), seed), "detector-evaluation")
    report = N.comparison(history, usable, evaluation, min_rows)
    if prints.isEmpty():
        return report
    models = fitted(usable, evaluation.filter("selected").select("repo_id", "model"))
    facts = metadata(history, usable, evaluation, prints, min_rows, seed)
    facts = facts.select("repo_id", F.struct(*[c for c in facts.columns if c != "repo_id"]).alias("metadata"))
    store.publish(models.join(facts, "repo_id"), prints)
    return report


def scored_by(models: DataFrame, current: DataFrame) -> DataFrame:
    """(repo_id, run_id, selected_model, prediction, anomaly_score) of numeric runs by loaded detectors."""
    stats = models.select(
        "repo_id", "model",
        *[F.col("mean")[i].alias(f"{c}_mean") for i, c in enumerate(P.ANOMALY_FEATURES)],
        *[F.col("dev")[i].alias(f"{c}_dev") for i, c in enumerate(P.ANOMALY_FEATURES)],
    )
    keep = ["repo_id", "run_id"]
    x = D.scale(current.join(models.select("repo_id", "model"), "repo_id"), stats.drop("model"))
    x = cut_lineage(x.select(*keep, "model", "x"), "current-x")
    out = None
    for name, held in ((N.FOREST, "forest"), (N.RBF, "rbf")):
        mine = models.filter(F.col("model") == name)
        rows = N.score_detector(name, x.filter(F.col("model") == name).drop("model"), mine.select("repo_id", f"{held}.*"))
        found = D.verdict(rows, mine.select("repo_id", "cut")).select(
            *keep, F.lit(name).alias("selected_model"), "prediction", F.col("decision_value").alias("anomaly_score")
        )
        out = found if out is None else out.unionByName(found)
    return out


def detect_saved(current: DataFrame, history_rows: DataFrame, path: str, version: int | None = None, min_rows: int = P.DEFAULT_MIN_ROWS) -> DataFrame:
    """Anomaly report rows for current runs by the detectors of a stored version (default: the current one). Nothing is fitted.

    ``history_rows`` is (repo_id, history_rows). A run whose table lacks a feature that its detector was trained on is FAILED, with
    the missing columns named; other conditions are those of :func:`gatewright.operators.history.anomaly_report`.
    """
    models = detector_store(current.sparkSession, path).read(version)
    there = F.array(*[F.lit(c) for c in current.columns])
    for c in P.ANOMALY_FEATURES:
        if c not in current.columns:
            current = current.withColumn(c, F.lit(None).cast("double"))
    checked = Q.check_numeric(current)
    if models is None:
        ready = checked.withColumns({
            "model_ready": F.lit(False), "schema_failure": F.lit(None).cast("string"), "selected_model": F.lit(None).cast("string"),
            "prediction": F.lit(None).cast("int"), "anomaly_score": F.lit(None).cast("double"),
        })
    else:
        numeric = checked.filter("numeric_failure is null").withColumns({c: F.col(c).cast("double") for c in P.ANOMALY_FEATURES})
        missing = F.array_except("features", there)
        # Fixed value: the failure sentence.
        sentence = F.concat(F.lit("CURRENT_METRICS_SCHEMA_INCOMPATIBLE: missing feature columns "), F.array_join(missing, ", "))
        known = models.select("repo_id", F.lit(True).alias("model_ready"), F.when(F.size(missing) > 0, sentence).alias("schema_failure"))
        ready = checked.join(known, "repo_id", "left").join(scored_by(models, numeric), ["repo_id", "run_id"], "left")
    rows = ready.join(history_rows, "repo_id", "left").withColumns({
        "history_rows": F.coalesce("history_rows", F.lit(0)),
        "min_rows_required": F.lit(min_rows),
        "load_error": F.lit(""),
    })
    return H.anomaly_report(rows)
