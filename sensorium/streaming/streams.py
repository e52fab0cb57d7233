"""Structured Streaming twins of the day buckets, scoring, baselines, persistence and periods.

Operators that need earlier rows of a tag keep them as a small table per micro-batch and
run the ordinary batch operator on "kept rows + new rows". A busy tag is then cut into
blocks like in a batch job, a repeated micro-batch overwrites its own output, and the
state survives any executor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorium.functions.classes import z_ladder
from sensorium.functions.scalar import one
from sensorium.operators.windows import rolling_baseline
from sensorium.plans.attach import attach
from sensorium.series import Series

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", files: int | None = None) -> DataFrame:
    """Readings from a folder that receives Parquet files of events; event time is a session-zone timestamp."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("row_index"), F.col("event_type").alias("tag"), "value"
    )


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process everything that is there, micro-batch by micro-batch, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return query


def parts_writer(path: str, *parts: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch into its own folder; a repeated batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*parts) if parts else writer).parquet(f"{path}/batch={batch}")

    return write


def daily_buckets(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Per day and tag: count, mean, min and max; a day is final once the watermark has passed it.

    Readings for a finished day are dropped; a replay of the day is a batch job.
    """
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "tag")
    out = days.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select(F.to_date("window.start").alias("day"), "tag", "n", "mean", "low", "high")


def score_frozen(stream: DataFrame, limits: DataFrame, rows: int | None = None) -> DataFrame:
    """z ladder of new readings on stored limits (``tag, center, scale``); no state."""
    df = attach(stream, limits.select("tag", "center", "scale"), "tag", rows)
    df = df.withColumn("z", (F.col("value") - F.col("center")) / F.col("scale"))
    return df.withColumn("final_class", z_ladder(F.abs("z"), F.lit(3.0), F.lit(3.5), F.lit(5.0)))


def sliding_mean(stream: DataFrame, span: str = "5 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mean over sliding spans on a fixed grid of ends."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", span, step), "tag").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return out.select(F.col("window.end").cast("timestamp_ntz").alias("span_end"), "tag", "mean", "n")


def flagged_periods(stream: DataFrame, gap: str = "48 hours", late: str = "1 day") -> DataFrame:
    """Flagged readings of a tag merged while the gap stays below ``gap``."""
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "tag")
    out = out.agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"), F.count("value").alias("points"), F.max("value").alias("peak"))
    return out.select("tag", F.col("_a").cast("timestamp_ntz").alias("start_ts"), F.col("_b").cast("timestamp_ntz").alias("end_ts"), "points", "peak")


def deduped(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """First arrival of each key inside the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class KeptRows:
    """The rows of each tag that the next micro-batch still needs, stored per batch."""

    def __init__(self, path: str):
        self.path = path

    def before(self, spark: SparkSession, batch: int) -> DataFrame | None:
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch - 1}/_SUCCESS")
        fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return spark.read.parquet(f"{self.path}/batch={batch - 1}") if batch > 0 and fs.exists(jvm_path) else None

    def keep(self, rows: DataFrame, batch: int, count: int) -> None:
        """The newest ``count`` rows of each tag; the row limit is applied before the shuffle too."""
        newest = Window.partitionBy("tag").orderBy(F.desc("ts"), F.desc("row_index"))
        kept = rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= count).drop("_r")
        kept.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def baseline_writer(out: str, kept: KeptRows, window: int = 30, k: float = 3.0) -> Callable[[DataFrame, int], None]:
    """Mean, std, z and limits from the previous ``window`` rows of the tag, across micro-batches."""

    def write(df: DataFrame, batch: int) -> None:
        new = df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("_new", F.lit(True))
        old = kept.before(df.sparkSession, batch)
        rows = new if old is None else new.unionByName(old.withColumn("_new", F.lit(False)))
        rows = rows.persist()
        scored = rolling_baseline(Series(rows), window, k).where("_new").drop("_new")
        scored.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        kept.keep(rows.drop("_new"), batch, window)
        rows.unpersist()

    return write


def persistence_writer(out: str, kept: KeptRows, limit: float, radius: int = 2) -> Callable[[DataFrame, int], None]:
    """Flag support among ``radius`` neighbours on both sides and the run length so far.

    A reading is written once ``radius`` later readings of its tag have arrived; the
    newest ones wait for the next micro-batch.
    """

    def write(df: DataFrame, batch: int) -> None:
        new = df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumns(
            {"flag": F.coalesce(F.col("value") > limit, F.lit(False)), "_done": F.lit(False)}
        )
        old = kept.before(df.sparkSession, batch)
        rows = (new if old is None else new.unionByName(old)).persist()
        lane = Series(rows).lane().rolling(
            radius,
            radius,
            lambda w: {
                "support": F.sum(one(F.col("flag"))).over(w.rowsBetween(-radius, radius)),
                "_ahead": F.count("tag").over(w.rowsBetween(1, radius)),
            },
        )
        scored = lane.done().withColumn("_ready", F.col("_ahead") == radius).persist()
        final = scored.where(F.col("_ready") & ~F.col("_done")).select("ts", "tag", "value", "flag", F.col("support").cast("long"))
        final.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        waiting = scored.withColumn("_done", F.col("_ready")).select(*rows.columns)
        kept.keep(waiting, batch, 2 * radius)
        scored.unpersist()
        rows.unpersist()

    return write


__all__ = [
    "KeptRows",
    "baseline_writer",
    "daily_buckets",
    "deduped",
    "event_stream",
    "flagged_periods",
    "parts_writer",
    "persistence_writer",
    "run_available",
    "score_frozen",
    "sliding_mean",
]
