"""Mean RBF kernel values with a proven error: training rows are collapsed into cells, and cells meet rows in tiles.

The mean of a cell stands for its rows. The first-order terms of the kernel cancel around a mean and its second derivatives
are at most 2 * gamma, so the mean kernel of a repository is off by at most gamma times the mean squared distance of its rows to
their cells' means. With a tolerance of 0 a cell is one distinct row, and the sums are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.operators.batches import batches_for, met_in_batches
from gatewright.operators.detectors import rbf_gamma
from gatewright.session import cut_lineage

#: Rows and cells of a tile, at most about; a tile is worked off in strips.
TILE = 4096
STRIP = 512
#: Pairs that count as much as a row when batches are made.
PAIRS_A_ROW = 1000


def kernel_cells(train: DataFrame, width: int, tolerance: float = 0.0) -> DataFrame:
    """(repo_id, gamma, center, n, spread) from scaled rows ``repo_id, x``; ``spread`` is the squared distance to the center, summed.

    The side of a cell is such that the error can't exceed ``tolerance`` wherever the rows lie in it; rows that agree in all
    digits share a cell in any case. One aggregation with map-side sums, whatever the size of a repository.
    """
    if tolerance < 0:
        raise ValueError(f"tolerance must not be negative: {tolerance}")
    rows = train.select("repo_id", "x").join(rbf_gamma(train, width), "repo_id")
    side = 2 * F.sqrt(F.lit(float(tolerance)) / (F.col("gamma") * width))
    cell = F.transform("x", lambda v: F.floor(v / side)) if tolerance else F.col("x")
    value = [F.col("x")[i] for i in range(width)]
    grouped = rows.groupBy("repo_id", "gamma", cell.alias("cell")).agg(
        F.array(*[F.avg(v) for v in value]).alias("center"),
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) * sum((F.var_pop(v) for v in value), F.lit(0.0))).alias("spread"),
    )
    return grouped.drop("cell")


def kernel_error(cells: DataFrame) -> DataFrame:
    """(repo_id, cells, rows, bound): no mean kernel value of the repository is further from the exact one than ``bound``."""
    return cells.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("n").alias("rows"),
        (F.first("gamma") * F.sum("spread") / F.sum("n")).alias("bound"),
    )


def kernel_score(rows: DataFrame, cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Add ``sample_score`` to scaled rows ``repo_id, x``: the mean kernel value to the repository's cells.

    Distinct points and cells are dealt into shares and blocks of about ``tile``; pairs of them meet in batches, so a
    repository of any size is worked off by many tasks, and many small ones by few calls. Rows of repositories without cells are left out, repeated rows stay.
    """
    cells = cut_lineage(cells, "kernel-cells")
    points = cut_lineage(rows.select("repo_id", "x").distinct(), "kernel-points")
    counts = (
        points.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / tile).alias("shares"), F.count(F.lit(1)).alias("points"))
        .join(cells.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / tile).alias("blocks"), F.count(F.lit(1)).alias("cells"), F.sum("n").alias("total")), "repo_id")
    )
    counts = cut_lineage(counts, "kernel-counts")

    def every(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = points.join(counts, "repo_id").select(
        "repo_id", F.pmod(F.xxhash64("x"), F.col("shares")).alias("share"), every("blocks").alias("block"), "x"
    )
    right = cells.join(counts, "repo_id").select(
        "repo_id", every("shares").alias("share"), F.pmod(F.xxhash64("center"), F.col("blocks")).alias("block"), "gamma", "center", "n"
    )

    def sums(points: pd.DataFrame, cells: pd.DataFrame, groups: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        a, b = np.stack(points["x"].to_numpy()), np.stack(cells["center"].to_numpy())
        weight, gamma, out = cells["n"].to_numpy(np.float64), cells["gamma"].to_numpy(), np.empty(len(a))
        norm_a, norm_b, done = (a * a).sum(1), (b * b).sum(1), np.zeros(len(a), dtype=bool)
        for mine, theirs in groups:
            c, n, squares, g = b[theirs], weight[theirs], norm_b[theirs], gamma[theirs[0]]
            for at in range(0, len(mine), STRIP):
                p = mine[at : at + STRIP]
                apart = norm_a[p][:, None] + squares - 2 * (a[p] @ c.T)
                out[p] = np.exp(-g * np.maximum(apart, 0)) @ n
            done[mine] = True
        return points.assign(part=out)[done]

    keys = ["repo_id", "share", "block"]
    pairs = counts.agg(F.sum(F.col("points").cast("double") * F.col("cells") / PAIRS_A_ROW + F.col("points") * F.col("blocks") + F.col("cells") * F.col("shares"))).first()[0]
    parts = met_in_batches(left, right, keys, batches_for(rows.sparkSession, pairs), sums, "repo_id string, x array<double>, part double")
    scores = parts.groupBy("repo_id", "x").agg(F.sum("part").alias("part")).join(counts.select("repo_id", "total"), "repo_id")
    scores = scores.select("repo_id", "x", F.round(F.col("part") / F.col("total"), 9).alias("sample_score"))
    return rows.join(scores, ["repo_id", "x"]).select(*rows.columns, "sample_score")
