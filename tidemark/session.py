"""Session helpers.

On a cluster the session is created by the platform; we only *read* its
settings.  ``get_session`` is for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "tidemark",
) -> SparkSession:
    """Local/test session with AQE on and the web UI off."""
    master = master or os.environ.get("TIDEMARK_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("TIDEMARK_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small local inputs: keep AQE from coalescing a stage into one task
        # (on a cluster the platform's defaults / data volume govern this)
        .config(
            "spark.sql.adaptive.coalescePartitions.minPartitionSize",
            os.environ.get("TIDEMARK_MIN_PARTITION_SIZE", "64k"),
        )
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/S3/ABFS) folder there; we read it and never
    invent a machine-local one: without the setting a cluster session raises.
    Only a local session (tests, bench) gets a scratch folder of its own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def task_count(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows`` rows with at most ``per_task`` in each, the session's shuffle partitions at least.

    For exchanges before a sort or an aggregate of a table whose rows are
    short: Spark merges partitions by their bytes, and a fixed setting does
    not follow the table.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]):
    """The session has ``values`` inside; what it had before is put back after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shuffles_dropped(spark: SparkSession):
    """Each query that runs inside drops its shuffle files when it is done.

    For a row of writes that read back what was written: no later job reads an
    earlier one's exchanges, which otherwise stay on disk until the driver's
    garbage collection finds them.  The session's setting is put back after.
    """
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
