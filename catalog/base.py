"""Registry of queries and shared SQL fragments for the comparison engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType

from sensorium.session import shared_folder, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query; doubles are rounded and counts are widened on the way out."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return tidy(fn(spark, folder), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.replace(", 6) + 0.0", f", {digits}) + 0.0")
        return fn

    return wrap


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/entry-{uuid.uuid4().hex}"


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DoubleType | FloatType):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(field.dataType, ByteType | ShortType | IntegerType):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


# -- SQL fragments -----------------------------------------------------------

SENSOR = "sensor AS (SELECT ts, event_id AS row_index, event_type AS tag, value FROM events)"
USER = "users AS (SELECT ts, event_id AS row_index, CAST(user_id AS VARCHAR) AS tag, value FROM events)"
HOURLY = (
    "hourly AS (SELECT date_trunc('hour', ts) AS ts, event_type AS tag, avg(value) AS value, 0 AS row_index "
    "FROM events GROUP BY ALL)"
)
PAIRS = [(f, s) for f in ("A", "N", "R") for s in ("F", "O")]
SHIP_TAGS = ["qty_sum", "price_avg", "disc_avg", "tax_avg", "line_count"] + [f"qty_{f}_{s}" for f, s in PAIRS]
SHIPW = (
    "shipw AS (SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, sum(l_quantity) AS qty_sum, "
    "round(avg(l_extendedprice), 6) AS price_avg, round(avg(l_discount), 8) AS disc_avg, round(avg(l_tax), 8) AS tax_avg, "
    "CAST(count(*) AS DOUBLE) AS line_count, "
    + ", ".join(
        f"coalesce(sum(l_quantity) FILTER (l_returnflag='{f}' AND l_linestatus='{s}'), 0.0) AS qty_{f}_{s}" for f, s in PAIRS
    )
    + " FROM lineitem GROUP BY 1)"
)
SHIP = (
    SHIPW
    + ", ship AS (SELECT ts, tag, value, 0 AS row_index FROM shipw UNPIVOT INCLUDE NULLS (value FOR tag IN ("
    + ", ".join(SHIP_TAGS)
    + ")))"
)
ORDERS = (
    "ords AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, o_orderpriority AS tag, "
    "round(avg(o_totalprice), 6) AS value, 0 AS row_index FROM orders GROUP BY 1, 2)"
)
PATHS = (
    "paths AS (SELECT DISTINCT r_name || ' -> ' || n_name || ' -> ' || c_mktsegment || ' -> ' || o_orderpriority AS path "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey)"
)


def r(expr: str, name: str | None = None) -> str:
    """Rounded double with a name."""
    return f"round({expr}, 6) + 0.0 AS {name or expr.split('.')[-1]}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def center_scale(src: str, column: str, out: str, policy: str = "std1", eps: str = "1e-9", where: str = "TRUE") -> str:
    """CTE ``out``: tag, n, mean, std, center, mad, scale of a column."""
    mad = "1.4826 * mad"
    std = "std0" if policy == "std0" else "std"
    if policy == "floor":
        scale = f"CASE WHEN mad > 0 THEN {mad} ELSE {eps} END"
    elif policy == "zero":
        scale = f"CASE WHEN mad > 0 THEN {mad} END"
    elif policy == "ladder":
        scale = (
            f"CASE WHEN {mad} > {eps} THEN {mad} WHEN std > {eps} THEN std "
            f"WHEN (q75 - q25) / 1.349 > {eps} THEN (q75 - q25) / 1.349 ELSE {eps} END"
        )
    else:
        last = "1.0" if policy == "unit" else eps
        scale = f"CASE WHEN {mad} >= {eps} THEN {mad} WHEN {std} >= {eps} THEN {std} ELSE {last} END"
    return (
        f"{out} AS (SELECT tag, n, mean, std, std0, center, mad, CASE WHEN n > 0 THEN {scale} END AS scale FROM ("
        f"SELECT tag, count({column}) AS n, avg({column}) AS mean, stddev_samp({column}) AS std, stddev_pop({column}) AS std0, "
        f"median({column}) AS center, mad({column}) AS mad, quantile_cont({column}, 0.25) AS q25, quantile_cont({column}, 0.75) AS q75 "
        f"FROM {src} WHERE {where} GROUP BY tag))"
    )


W = "PARTITION BY tag ORDER BY ts, row_index"
