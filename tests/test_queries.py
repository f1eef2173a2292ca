"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.check_queries import rows_of

CHECKS = entry_points.oracle_sql()
# Rows-only queries are covered by the operator tests; these few run here to keep the suite short.
ROWS_ONLY = ["fn28_now_utc", "snk03_model_metadata"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, sf, duck, name):
    df = entry_points.queries()[name](spark, sf)
    found = duck.execute(CHECKS[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only(spark, sf, name):
    assert entry_points.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(entry_points.queries())
