"""Mean kernel values: exact sums over tiles, and cells with a proven bound."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright.operators import kernel as K

SCHEMA = "repo_id string, run_id int, x array<double>"


def mean_kernel(x):
    gamma = 1 / (x.shape[1] * x.var()) if x.var() > 1e-9 else 1.0
    return np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1)).mean(1)


def tables(spark):
    rng = np.random.default_rng(4)
    given = {
        "wide": rng.normal(size=(400, 4)),
        "copies": np.repeat(np.round(rng.normal(size=(9, 4)), 1), 70, axis=0),
        "flat": np.zeros((30, 4)),
        "far": np.r_[rng.normal(size=(200, 4)), rng.normal(size=(3, 4)) + 40],
    }
    rows = [(repo, i, [float(v) for v in x]) for repo, xs in given.items() for i, x in enumerate(xs)]
    return given, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("tile", [60, 4096])
def test_sums_over_tiles_are_exact(spark, tile):
    given, rows = tables(spark)
    found = K.kernel_score(rows, K.kernel_cells(rows, 4), tile).collect()
    assert len(found) == rows.count()
    want = {(repo, i): v for repo, x in given.items() for i, v in enumerate(mean_kernel(x))}
    assert max(abs(r.sample_score - want[r.repo_id, r.run_id]) for r in found) < 2e-9


@pytest.mark.parametrize("tolerance", [0.01, 0.1])
def test_cells_hold_their_bound(spark, tolerance):
    given, rows = tables(spark)
    cells = K.kernel_cells(rows, 4, tolerance)
    bounds = {r.repo_id: r for r in K.kernel_error(cells).collect()}
    off = dict.fromkeys(given, 0.0)
    want = {(repo, i): v for repo, x in given.items() for i, v in enumerate(mean_kernel(x))}
    for r in K.kernel_score(rows, cells).collect():
        off[r.repo_id] = max(off[r.repo_id], abs(r.sample_score - want[r.repo_id, r.run_id]))
    for repo, x in given.items():
        assert off[repo] <= bounds[repo].bound + 1e-8 and bounds[repo].bound <= tolerance
        assert bounds[repo].rows == len(x)
    assert bounds["copies"].cells <= 9 and bounds["flat"].cells == 1
    assert bounds["copies"].bound < 1e-9 or bounds["copies"].cells < 9
    if tolerance == 0.1:
        assert bounds["wide"].cells < 400


def test_rows_of_other_repositories_and_empty_tables(spark):
    _, rows = tables(spark)
    cells = K.kernel_cells(rows.where("repo_id = 'flat'"), 4)
    assert {r.repo_id for r in K.kernel_score(rows, cells).select("repo_id").distinct().collect()} == {"flat"}
    assert K.kernel_score(rows.limit(0), cells).count() == 0
    assert K.kernel_score(rows, K.kernel_cells(rows.limit(0), 4)).count() == 0
    extra = rows.where("repo_id = 'flat'").withColumn("note", F.lit("n"))
    assert [r.sample_score for r in K.kernel_score(extra, cells).collect()] == [1.0] * 30
    with pytest.raises(ValueError):
        K.kernel_cells(rows, 4, -1)
