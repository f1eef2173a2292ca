"""Session helpers: a tuned builder and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app: str = "gatewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE (coalescing and skew-join splitting), Arrow and UTC switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    Where that setting is absent, a local master (tests, a laptop) gets a temporary folder and any other master an error:
    executors would each write to their own disk and the driver would read back only its own part.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="gatewright-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df, label: str = "stage"):
    """Write ``df`` once to the shared scratch folder and read it back, so later steps do not recompute it.

    A written table outlives lost executors, unlike cached blocks.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends. A loop otherwise keeps those of all its rounds until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def spread(df, *keys: str):
    """Hash partitions for a grouped Python step.

    AQE sizes shuffle partitions by bytes and would merge a few megabytes into one task, although each group may cost
    seconds of Python. A numbered repartition keeps its width and is the exchange the grouping needs anyway.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def widen(scan):
    """Spread a scan that yields fewer tasks than there are cores (one unsplittable file) before heavy text work.

    Only for plain scans and projections: counting their tasks runs nothing. A large table is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.rdd().getNumPartitions() >= cores else scan.repartition(cores)
