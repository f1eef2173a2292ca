"""Classifier candidates, training, selection and scoring."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType

from gatewright import params as P
from gatewright.functions import alerts as A
from gatewright.functions.risk import positive_score
from gatewright.operators import evaluation as E
from gatewright.operators.features import (
    MESSAGE_TERMS,
    class_weights,
    feature_columns,
    fit_tfidf,
    scaling_stats,
)
from gatewright.operators.forest import SparseForest
from gatewright.operators.linear import HINGE, LOGISTIC, LinearClassifier
from gatewright.operators.network import SparseNetwork
from gatewright.operators.rows import rank_alerts
from gatewright.operators.runs import score_risk
from gatewright.session import cut_lineage, scratch_dir
from gatewright.sources.readers import file_bytes

TASK_BYTES = 8 << 20
TREE_DEPTH = 30  # as deep as MLlib allows: trees grow until their leaves are pure


def one_hot_stages(columns: list[str]) -> list[Estimator]:
    """Index and encode; an unseen value falls into the bucket that ``dropLast`` removes, so it encodes as zeros."""
    index = StringIndexer(inputCols=columns, outputCols=[f"__{c}_i" for c in columns], handleInvalid="keep",
                          stringOrderType="alphabetAsc")
    encode = OneHotEncoder(inputCols=[f"__{c}_i" for c in columns], outputCols=[f"__{c}_v" for c in columns], dropLast=True)
    return [index, encode]


def feature_model(train: DataFrame, variant: str, terms: int = MESSAGE_TERMS) -> PipelineModel:
    """Scaled numbers, one-hot categories and message TF-IDF assembled into ``features``."""
    numeric, categorical = feature_columns(variant)
    fitted = Pipeline(stages=one_hot_stages(categorical)).fit(train)
    text = fit_tfidf(train, "message", "words", terms, "__msg")
    parts = [*[f"__{c}_s" for c in numeric], *[f"__{c}_v" for c in categorical], "__msg"]
    assemble = VectorAssembler(inputCols=parts, outputCol="features")
    return PipelineModel([scaling_stage(train, numeric), *fitted.stages, *text, assemble])


def scaling_stage(train: DataFrame, columns: list[str]) -> SQLTransformer:
    """(x - mean) / population deviation with the fitted numbers written into the statement (one row of statistics)."""
    stats = scaling_stats(train, columns).first()
    parts = []
    for c in columns:
        dev = stats[f"{c}_dev"] if stats[f"{c}_dev"] > 1e-9 else 1.0
        parts.append(f"({c} - {stats[f'{c}_mean']!r}D) / {dev!r}D AS __{c}_s")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def candidates(task: str, rows: int, width: int, seed: int = P.SEED, depth: int = TREE_DEPTH) -> dict[str, Estimator]:
    """Four classifiers. ``task``: commit_risk (two classes), cppcheck or clang (three classes)."""
    trees = {"commit_risk": 100, "cppcheck": 200, "clang": 300}[task]
    hidden = [64] if task == "commit_risk" else [128, 64]
    classes = 2 if task == "commit_risk" else 3
    return {
        "Logistic Regression": LinearClassifier(loss=LOGISTIC, classes=classes, weightCol="weight", regParam=1.0 / rows, maxIter=2000),
        "SVM": LinearClassifier(loss=HINGE, classes=classes, weightCol="weight", regParam=1.0 / rows, maxIter=5000),
        "Random Forest": SparseForest(classes=classes, numTrees=trees, maxDepth=depth, weightCol="weight", seed=seed),
        "ANN": SparseNetwork(layers=[width, *hidden, classes], seed=seed, maxIter=20 if task == "commit_risk" else 500),
    }


def _score_column(scored: DataFrame) -> DataFrame:
    """Add ``score`` of class 1 from whatever the classifier offers."""
    if "probability" in scored.columns:
        return scored.withColumn("score", positive_score("probability", F.col("probability")))
    if "rawPrediction" in scored.columns:
        return scored.withColumn("score", positive_score("margin", vector_to_array("rawPrediction")[1]))
    return scored.withColumn("score", positive_score("prediction", F.col("prediction")))


def evaluate(scored: DataFrame, task: str) -> DataFrame:
    """One row of metrics."""
    rows = scored.withColumn("prediction", F.col("prediction").cast("int"))
    if task != "commit_risk":
        return E.multi_metrics(rows, [])
    with_score = _score_column(rows)
    metrics = E.binary_metrics(with_score, [])
    return metrics.join(F.broadcast(E.roc_auc(with_score.withColumn("__g", F.lit(0)), ["__g"]).drop("__g")))  # one row each


def rows_for(estimator: Estimator, rows: DataFrame) -> DataFrame:
    """A forest cuts the rows into blocks and deals them to its trees, so it gets a task for each core at least; the
    solvers run a short job per iteration and get the rows as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, 1 + rows.count() // 100_000)) if isinstance(estimator, SparseForest) else rows


def train_and_select(
    train: DataFrame, valid: DataFrame, test: DataFrame, task: str, features: PipelineModel,
    names: list[str] | None = None,
) -> tuple[str, PipelineModel, DataFrame, DataFrame]:
    """Fit the candidates, rank them on the validation split, score the best once on the test split.

    The features are computed once and written to shared storage; every candidate reads that table.
    """
    spark = train.sparkSession
    weight = class_weights(train)
    paths = {}
    for name, part in {"train": train, "valid": valid, "test": test}.items():
        table = features.transform(part).select("label", "features")
        paths[name] = scratch_dir(spark, f"features-{name}")
        table.withColumn("weight", weight if name == "train" else F.lit(1.0)).write.parquet(paths[name])
    # solvers run a job per iteration, whose cost on a small table is that of its tasks: one for each ``TASK_BYTES``
    x = {name: spark.read.parquet(path).coalesce(1 + file_bytes(spark, path) // TASK_BYTES) for name, path in paths.items()}
    width = x["train"].select(F.size(vector_to_array("features"))).first()[0]
    rows = x["train"].count()
    fitted, table = {}, None
    wanted = {k: v for k, v in candidates(task, rows, width).items() if names is None or k in names}
    for position, (name, estimator) in enumerate(wanted.items()):  # at most four candidates
        fitted[name] = estimator.fit(rows_for(estimator, x["train"]))
        row = evaluate(fitted[name].transform(x["valid"]), task).withColumn("model", F.lit(name)).withColumn(
            "candidate", F.lit(position)
        )
        table = row if table is None else table.unionByName(row)
    policy = "commit_risk" if task == "commit_risk" else "alert_priority"
    ranked = spark.createDataFrame(E.rank_models(table, policy, first="candidate").collect(), _nullable_schema(table))
    best = ranked.filter("selection_rank = 1").first()["model"]
    final = evaluate(fitted[best].transform(x["test"]), task).withColumn("model", F.lit(best))
    return best, PipelineModel([*features.stages, fitted[best]]), ranked, final


def _nullable_schema(table: DataFrame):
    schema = table.schema.add("selection_rank", IntegerType()).add("selected", BooleanType())
    for field in schema.fields:
        field.nullable = True
    return schema


def score_functions(model: PipelineModel, functions: DataFrame, params: P.RiskParams | None = None) -> DataFrame:
    """Changed functions with probability, score, level, terms and reason."""
    scored = _score_column(model.transform(functions)).withColumnRenamed("score", "risk_probability")
    plain = scored.select(*functions.columns, F.col("risk_probability").alias("probability"))
    return score_risk(plain, params, code="function_code")


def prioritise(model: PipelineModel, alerts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Alerts with predicted priority, from HIGH to LOW. They are written before they are sorted: a sort reads its input twice, first for
    the bounds of its ranges, and would score them twice."""
    scored = model.transform(alerts).withColumn("priority", A.priority_of(F.col("prediction")))
    columns = ["priority", "tool", "file", "line", "alert_id", "cwe", "severity", "message"]
    return rank_alerts(cut_lineage(scored.select(*(keep or []), *columns), "scored-alerts"))
