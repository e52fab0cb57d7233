"""Series shapes derived from the star-schema tables and the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorium.series import Series
from sensorium.sources.wide import to_observations


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sensor_long(spark: SparkSession, folder: str) -> Series:
    """Events as readings: one tag per event type."""
    events = table(spark, folder, "events")
    return Series(
        events.select(
            "ts",
            F.col("event_id").alias("row_index"),
            F.col("event_type").alias("tag"),
            "value",
        )
    )


def user_long(spark: SparkSession, folder: str) -> Series:
    """Events as readings: one tag per user (many tags)."""
    events = table(spark, folder, "events")
    return Series(
        events.select(
            "ts",
            F.col("event_id").alias("row_index"),
            F.col("user_id").cast("string").alias("tag"),
            "value",
        )
    )


def sensor_hourly(spark: SparkSession, folder: str) -> Series:
    """Mean per hour and event type; hours without readings are missing."""
    events = table(spark, folder, "events")
    hours = events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("tag"))
    return Series(hours.agg(F.avg("value").alias("value"))).stored()


# The return-flag / line-status pairs that get a tag of their own.
SHIP_PAIRS = [(flag, status) for flag in ("A", "N", "R") for status in ("F", "O")]
SHIP_TAGS = ["qty_sum", "price_avg", "disc_avg", "tax_avg", "line_count"] + [
    f"qty_{flag}_{status}" for flag, status in SHIP_PAIRS
]


def ship_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ship day with eleven measures; a pair without lines counts 0."""
    lines = table(spark, folder, "lineitem")
    pair_sums = [
        F.coalesce(
            F.sum(F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), F.col("l_quantity"))),
            F.lit(0.0),
        ).alias(f"qty_{flag}_{status}")
        for flag, status in SHIP_PAIRS
    ]
    return lines.groupBy(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts")).agg(
        F.sum("l_quantity").alias("qty_sum"),
        F.round(F.avg("l_extendedprice"), 6).alias("price_avg"),
        F.round(F.avg("l_discount"), 8).alias("disc_avg"),
        F.round(F.avg("l_tax"), 8).alias("tax_avg"),
        F.count(F.lit(1)).cast("double").alias("line_count"),
        *pair_sums,
    )


def ship_daily(spark: SparkSession, folder: str) -> Series:
    """``ship_wide`` as long readings: eleven tags on a complete daily grid."""
    return Series(to_observations(ship_wide(spark, folder), SHIP_TAGS), tags=len(SHIP_TAGS)).stored()


def order_daily(spark: SparkSession, folder: str) -> Series:
    """Mean order price per day and priority; days without orders are missing."""
    orders = table(spark, folder, "orders")
    days = orders.groupBy(
        F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderpriority").alias("tag")
    )
    return Series(days.agg(F.round(F.avg("o_totalprice"), 6).alias("value"))).stored()


def cause_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct region -> nation -> segment -> priority paths as text."""
    region = table(spark, folder, "region")
    nation = table(spark, folder, "nation")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderpriority")
    seen = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("c_nationkey", "c_mktsegment", "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    named = seen.join(nation, seen.c_nationkey == nation.n_nationkey).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return named.select(
        F.concat_ws(" -> ", "r_name", "n_name", "c_mktsegment", "o_orderpriority").alias("path")
    ).distinct()
