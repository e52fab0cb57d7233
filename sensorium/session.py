"""Session helpers: builder for local runs, row limits per task, durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS_KEY = "spark.sensorium.maxRowsPerTask"
TASK_ROWS_DEFAULT = 2_000_000
SMALL_ROWS_KEY = "spark.sensorium.maxBroadcastRows"
SMALL_ROWS_DEFAULT = 200_000


def local_session(cpus: int | str = "*", **extra: str) -> SparkSession:
    """A session for tests and benches; on a cluster use the cluster's own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sensorium")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def task_rows(spark: SparkSession) -> int:
    """Most rows of one key that a single task may sort or buffer."""
    return int(spark.conf.get(TASK_ROWS_KEY, str(TASK_ROWS_DEFAULT)))


def small_rows(spark: SparkSession) -> int:
    """Most rows a side may have to be broadcast."""
    return int(spark.conf.get(SMALL_ROWS_KEY, str(SMALL_ROWS_DEFAULT)))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        known = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used where a later step must see exactly the same partitioning twice, so the
    rows have to outlive the executors that made them.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that queries run from any working folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "sensorium_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
