"""Writers: report tables, append-once history, models with metadata."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gatewright.operators.quality import check_model_schema
from gatewright.sources.readers import path_exists


def write_report(df: DataFrame, path: str, csv: bool = False, partition_by: list[str] | None = None) -> None:
    """Parquet, or CSV with header; an empty result still leaves its schema.

    Rows of a repository are brought together and sorted, so a reader of one repository skips all other row groups.
    The rebalance hint lets AQE split a repository that outgrows one file and merge small ones. A folder per repository
    (``partition_by``) is for few, large repositories only.
    """
    if csv:
        flat = [
            F.array_join(F.col(f"`{f.name}`").cast("array<string>"), "|").alias(f.name)
            if f.dataType.typeName() == "array"
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
        df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')
        return
    keys = [c for c in (partition_by or ["repo_id"]) if c in df.columns]
    if keys:
        df = df.hint("rebalance", *keys).sortWithinPartitions(*keys)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def new_runs(history: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("repo_id", "run_id")) -> DataFrame:
    """Rows whose run is not in the history yet; of re-delivered rows the first by ``ord`` stays."""
    order = F.col("ord") if "ord" in rows.columns else F.lit(0)
    rest = [c for c in rows.columns if c not in keys]
    once = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")
    return once.select(*rows.columns).join(history.select(*keys), list(keys), "left_anti")


def append_once(spark, path: str, rows: DataFrame, keys: tuple[str, ...] = ("repo_id", "run_id")) -> bool:
    """Append only unseen runs to the history table.

    A folder without data files (a first write that never ended) counts as no history yet. An unreadable history, or one without
    the keys, is left as it is: nothing is added and the answer is False, which a stream must not pass over. Only the part of the
    history within the batch's range of the last key is read, so its cost follows the batch where runs are named by time.
    """
    try:
        history = _history(spark, path, keys)
    except (PySparkException, Py4JJavaError):
        return False
    if history is None:
        history = rows.limit(0)
    else:
        low, high = rows.agg(F.min(keys[-1]), F.max(keys[-1])).first()
        history = history.where(F.col(keys[-1]).between(F.lit(low), F.lit(high)))
    new_runs(history, rows, keys).write.mode("append").parquet(path)
    return True


def _history(spark, path: str, keys: tuple[str, ...]) -> DataFrame | None:
    """The keys of the history table, None where no data file is there."""
    if not path_exists(spark, path):
        return None
    try:
        return spark.read.parquet(path).select(*keys)
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def history_size(spark, path: str) -> int:
    """Number of history rows; 0 where it is missing or unreadable."""
    if not path_exists(spark, path):
        return 0
    try:
        return spark.read.parquet(path).count()
    except Exception:
        return 0


def load_model(spark, path: str, columns: list[str] | None = None) -> tuple[PipelineModel, Row]:
    """(model, metadata) as :func:`save_model` left them; ``columns``: the features, in order, that the caller will give it.

    A model that cannot be read, has no metadata, or was fitted on other features is an error that says so.
    """
    try:
        model = PipelineModel.load(f"{path}/model")
        metadata = spark.read.json(f"{path}/metadata").first()
    except (PySparkException, Py4JJavaError) as error:
        raise ValueError(f"Unable to load model at {path}: {str(error).splitlines()[0]}") from error
    if metadata is None:
        raise ValueError(f"Unable to load model at {path}: no metadata")
    if columns is not None:
        if "feature_columns" not in metadata:
            raise ValueError(f"Unable to inspect model feature schema: {path} names no feature columns")
        check_model_schema(metadata["feature_columns"], columns)
    return model, metadata


def save_model(model, metadata: DataFrame, path: str) -> None:
    """A fitted PipelineModel and its one-row metadata as JSON, side by side."""
    model.write().overwrite().save(f"{path}/model")
    metadata.write.mode("overwrite").json(f"{path}/metadata")
