"""Named queries over the given tables, each with its check in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatewright.plans.tables import Tables
from gatewright.plans.views import sql

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, needs: list[str] | None = None, check: str | None = None):
    """Register a query and, if given, its SQL twin (``needs``: the views the text reads)."""
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = sql(needs or [], check)
        return fn

    return add


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](Tables(spark, sf_dir))


def load_all() -> None:
    from gatewright.plans import (  # noqa: F401
        catalog_functions,
        catalog_learning,
        catalog_matching,
        catalog_metrics,
        catalog_tables,
    )
