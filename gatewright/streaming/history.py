"""Append-once history, daily metrics and prior-only scoring as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gatewright.functions.numbers import round_half_up
from gatewright.session import scratch_dir
from gatewright.sources.readers import path_exists
from gatewright.sources.sinks import append_once
from gatewright.streaming.updates import UpdateTable


def stream_history(runs: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each (repo_id, run_id) once.

    The anti join on the table drops re-delivered runs and makes a replayed batch harmless, so the result is the same after any
    restart. No watermark: a run that arrives late is appended like any other.
    """
    def append(batch: DataFrame, _: int) -> None:
        rows = batch.persist()  # read for the range of its runs and for the rows
        try:
            if not append_once(batch.sparkSession, table, rows):
                raise RuntimeError(f"the history at {table} cannot be read; the batch stays uncommitted")
        finally:
            rows.unpersist()

    return runs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()


def daily_metrics(alerts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Alert counts per repository and day, final once the watermark has passed the day; until then :func:`write_updates` keeps
    the counts so far."""
    return (
        alerts.withWatermark("ts", delay)
        .groupBy("repo_id", F.window("ts", "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total_alerts"),
            *[F.count_if(F.col("priority") == p).alias(f"{p.lower()}_alerts") for p in ("HIGH", "MEDIUM", "LOW")],
        )
        .select("repo_id", F.col("w.start").alias("day"), "total_alerts", "high_alerts", "medium_alerts", "low_alerts")
    )


def write_stream(df: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.outputMode("append").format("parquet").option("path", table)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_updates(df: DataFrame, table: str, checkpoint: str, keys: list[str], fanout: int = 8) -> StreamingQuery:
    """Rows that a batch changed, kept in levels (:class:`UpdateTable`); a replay changes nothing. :func:`latest` tells what holds now."""
    def save(batch: DataFrame, batch_id: int) -> None:
        UpdateTable(batch.sparkSession, table, keys, fanout).write(batch, batch_id)

    return (
        df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    )


def latest(spark: SparkSession, table: str, keys: list[str], schema: str) -> DataFrame:
    """Of each key the row of its last batch, from a number of folders that grows with the logarithm of the batches."""
    return UpdateTable(spark, table, keys).read(schema)


def stream_score(runs: DataFrame, baseline: str, output: str, checkpoint: str, feature: str = "total_alerts") -> StreamingQuery:
    """Score each arriving run against the last saved baseline (repo_id, mean, dev), never against itself."""
    def score(batch: DataFrame, batch_id: int) -> None:
        base = batch.sparkSession.read.parquet(baseline)
        dev = F.when(F.col("dev") > 0, F.col("dev")).otherwise(F.lit(1.0))
        scored = batch.join(base, "repo_id", "left").withColumn(
            "z", round_half_up((F.col(feature) - F.col("mean")) / dev, 6)
        )
        # One folder per batch: a replayed batch overwrites its own output.
        scored.drop("mean", "dev").write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return runs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(score).start()


MOMENTS = "n long, mean double, m2 double, last string"


def stream_prior_scores(
    runs: DataFrame, output: str, checkpoint: str, feature: str = "total_alerts", time: str = "ts", tie: str = "run_id"
) -> StreamingQuery:
    """Score each run (repo_id, run_id, ts, feature) against all runs of its repository before it, and against nothing else.

    A repository's state is the number, mean and sum of squared deviations of what it has seen, updated run by run in the order of
    ``time`` and ``tie``; a restart goes on with it. Columns: repo_id, run_id, ts, the feature, prior_runs, prior_mean, prior_std, z.
    The first run of a repository has no mean and no z; a deviation of zero divides by 1. A run that arrives after later ones
    were scored has ``late`` and is scored against what is known then. Null features are scored null and change nothing.
    """
    schema = f"repo_id string, {tie} string, {time} timestamp, {feature} double, prior_runs long, prior_mean double, prior_std double, z double, late boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def score(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames = list(parts)
        rows = frames[0] if len(frames) == 1 else pd.concat(frames)
        columns = [rows[c].tolist() for c in (time, tie, feature)]
        if len(rows) > 1:  # sorted here: a pandas sort costs more than all else of a short group
            # nulls come last, as pandas sorts them
            places = [(at is pd.NaT, 0 if at is pd.NaT else at, run is None, run or "") for at, run in zip(*columns[:2])]
            order = sorted(range(len(rows)), key=places.__getitem__)
            columns = [[c[i] for i in order] for c in columns]
        n, mean, m2, last = state.get if state.exists else (0, 0.0, 0.0, "")
        out = []
        for at, run, value in zip(*columns):
            place = f"{at.isoformat()}|{run}"
            std = (m2 / n) ** 0.5 if n else None
            known = n > 0 and value == value
            z = (value - mean) / (std if std and std > 0 else 1.0) if known else None
            out.append((key[0], run, at, value, n, mean if n else None, std, z, place < last))
            if value == value:
                n, gap = n + 1, value - mean
                mean += gap / n
                m2 += gap * (value - mean)
            last = max(last, place)
        state.update((n, mean, m2, last))
        yield pd.DataFrame(dict(zip(names, map(list, zip(*out)))))

    wanted = runs.select("repo_id", tie, time, F.col(feature).cast("double").alias(feature))
    scored = wanted.groupBy("repo_id").applyInPandasWithState(score, schema, MOMENTS, "append", GroupStateTimeout.NoTimeout)

    def save(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch overwrites its own output
        batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return scored.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    failure = query.exception()
    if failure:
        raise failure


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


__all__ = ["stream_history", "daily_metrics", "write_stream", "write_updates", "latest", "stream_score", "stream_prior_scores", "run_to_end", "read_table", "scratch_dir"]
