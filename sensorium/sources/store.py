"""Result tables on shared storage: runs, registry, upserts, exports and jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorium.functions.classes import lookup


def upserted(existing: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows with changed or new rows taking their place, by key."""
    keys = list(keys)
    return existing.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def upsert_partitions(existing: DataFrame, changes: DataFrame, keys: Sequence[str], part: str, path: str) -> None:
    """Write back only the partitions that the changes touch."""
    hit = existing.join(changes.select(part).distinct(), part, "left_semi")
    upserted(hit, changes, keys).write.mode("overwrite").partitionBy(part).option("partitionOverwriteMode", "dynamic").parquet(path)


def append_run(rows: DataFrame, path: str, part: str = "run_id") -> None:
    rows.write.mode("append").partitionBy(part).parquet(path)


def replace_children(rows: DataFrame, path: str, part: str = "run_id") -> None:
    """Replace the partitions present in ``rows`` and leave the others."""
    rows.write.mode("overwrite").partitionBy(part).option("partitionOverwriteMode", "dynamic").parquet(path)


def without_days_from(rows: DataFrame, day: str, column: str = "day") -> DataFrame:
    """Rows of earlier days; what follows is replayed."""
    return rows.where(F.col(column) < F.lit(day).cast("date"))


def dataset_hash(observations: DataFrame) -> DataFrame:
    """Content hash per dataset that does not depend on row order."""
    digest = F.xxhash64("row_index", "tag", "value")
    return observations.groupBy("dataset_id").agg(
        F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.sum(digest.cast("decimal(38,0)")), F.bit_xor(digest)), 256).alias("content_hash")
    )


def new_datasets(observations: DataFrame, registry: DataFrame) -> DataFrame:
    """Datasets whose content is not registered yet."""
    return dataset_hash(observations).join(registry.select("content_hash"), "content_hash", "left_anti")


def raw_rows(df: DataFrame, dataset_id: int, sheet: str, order: str) -> DataFrame:
    """Uploaded rows as JSON text beside their key."""
    return df.select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(sheet).alias("sheet"), F.col(order).alias("row_key"), F.to_json(F.struct(*df.columns)).alias("row_data")
    )


def causal_rows(paths: DataFrame) -> DataFrame:
    """Distinct trimmed non-empty paths with their payload."""
    p = paths.select(F.trim("path").alias("path")).where(F.col("path") != "").distinct()
    return p.select("path", F.to_json(F.struct("path")).alias("row_payload"))


def job_status(jobs: DataFrame) -> DataFrame:
    """Newest status row of each (plant, day) from an append-only job log."""
    w = Window.partitionBy("plant", "day").orderBy(F.desc("seq"))
    return jobs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def next_days(observed: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per plant: observed days that are neither completed nor skipped."""
    done = job_status(jobs).where(F.col("status").isin("completed", "skipped")).select("plant", "day")
    return observed.select("plant", "day").distinct().join(done, ["plant", "day"], "left_anti")


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV with a header in its own folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def to_points(results: DataFrame) -> DataFrame:
    """Classified consensus readings as point rows: status, scores, severity and action."""
    peer = F.col("fire_s5_peer")
    flagged = F.col("final_class") != "Normal"
    status = F.when(~flagged, "Normal").when(peer, "Outlier Only").otherwise("Process Issue Only")
    score = F.least(F.lit(5.0), F.col("signals_fired").cast("double"))
    action = lookup(
        "status",
        {
            "Outlier Only": "Validate instrument calibration and local control loops.",
            "Process Issue Only": "Check process setpoints, feed quality, and interlock history.",
        },
    )
    df = results.select(
        "tag",
        "ts",
        F.col("value").alias("tag_value"),
        status.alias("status"),
        F.when(peer & flagged, score).otherwise(0.0).alias("outlier_score"),
        F.when(~peer & flagged, score).otherwise(0.0).alias("process_issue_score"),
        "fence_lower",
        "fence_upper",
        "final_class",
        peer.alias("s5_peer_fired"),
    )
    return df.withColumn("suggested_action", action)
