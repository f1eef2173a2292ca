"""Python steps on many small groups: groups meet in batches, so a call's fixed cost is paid once a batch, not once a group."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.session import spread

#: Rows that meet in a batch, about.
BATCH_ROWS = 4096


def batches_for(spark, rows: float, per_batch: int = BATCH_ROWS) -> int:
    """Batches for so many rows: enough for every task, and none of much more than ``per_batch`` rows beside one large group."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((rows or 0) / per_batch))


def batch_of(keys: list[str], batches: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(batches))


def positions(frame: pd.DataFrame, keys: list[str]) -> dict[tuple, np.ndarray]:
    """The positions of each group's rows, in their order."""
    found = frame.groupby(keys if len(keys) > 1 else keys[0], sort=False, dropna=False).indices
    return {k if isinstance(k, tuple) else (k,): v for k, v in found.items()}


def met_in_batches(left: DataFrame, right: DataFrame, keys: list[str], batches: int, function: Callable, schema) -> DataFrame:
    """``function(left, right, groups)`` on batches of whole groups; ``groups`` are pairs of positions, one for each key on both sides."""
    names = schema.fieldNames() if hasattr(schema, "fieldNames") else [c.split()[0] for c in schema.split(", ")]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        mine, theirs = positions(a, keys), positions(b, keys)
        groups = [(i, theirs[k]) for k, i in mine.items() if k in theirs]
        return function(a, b, groups)[names] if groups else pd.DataFrame(columns=names)

    def dealt(df: DataFrame):
        return spread(df.withColumn("__batch", batch_of(keys, batches)), "__batch").groupBy("__batch")

    right = right.toDF(*right.columns)  # fresh column identities: both sides may come from the same table
    return dealt(left).cogroup(dealt(right)).applyInPandas(run, schema)
