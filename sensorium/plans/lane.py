"""Ordered rows of a key, computed without putting one whole key in one task.

A ``Lane`` is a table with a grouping key and a total order inside it. While the
largest key is known to fit one task it uses ordinary windows. Beyond that it
range-partitions the rows, numbers them, cuts every key into equal blocks and
 * gives framed windows the few neighbour rows they need from adjacent blocks;
 * adds block totals to running values, so no window spans a whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sensorium.session import settle, task_rows

POS = "_pos"
BLK = "_blk"
ONE = "_one"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest key; one map-side combined count over the key columns only."""
    if keys:
        row = df.groupBy(*keys).count().agg(F.max("count").alias("m")).first()
    else:
        row = df.agg(F.count(F.lit(1)).alias("m")).first()
    return int(row["m"] or 0)


class Lane:
    """``df`` grouped by ``keys`` and totally ordered by ``order`` inside each key."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        bound: int | None = None,
        limit: int | None = None,
    ):
        self.keys = list(keys) or [ONE]
        self.order = list(order)
        self.limit = task_rows(df.sparkSession) if limit is None else min(task_rows(df.sparkSession), limit)
        self.bound = largest_group(df, keys) if bound is None else bound
        if not keys:
            df = df.withColumn(ONE, F.lit(0))
        self.whole = self.bound <= self.limit
        self.block = max(self.limit, 1)
        if not self.whole:
            df = _numbered(df, self.keys, self.order, self.bound, self.limit)
        self.df = df

    @classmethod
    def placed(cls, df: DataFrame, keys: Sequence[str], order: Sequence[str], bound: int, limit: int) -> Lane:
        """A lane of all the rows that a lane cut into blocks of ``limit`` has numbered before; ``df`` still has their ``POS``."""
        lane = object.__new__(cls)
        lane.keys, lane.order, lane.bound, lane.df = list(keys), list(order), bound, df
        lane.limit = min(task_rows(df.sparkSession), limit)
        lane.whole, lane.block = False, max(lane.limit, 1)
        return lane

    # -- plain frames -------------------------------------------------------

    def _spec(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def rolling(
        self,
        back: int,
        ahead: int,
        *steps: Callable[[WindowSpec], dict[str, Column]],
    ) -> Lane:
        """Add framed columns; each step may use columns of the step before it.

        ``back``/``ahead`` are the total reach in rows of all steps together.
        """
        df = self.df
        if self.whole:
            spec = self._spec()
            for step in steps:
                df = df.withColumns(step(spec))
            return self._next(df)
        df = self._lent(back, ahead)
        spec = Window.partitionBy(*self.keys, BLK).orderBy(POS)
        for step in steps:
            df = df.withColumns(step(spec))
        return self._next(df.where("_own").drop("_own", BLK))

    def rolling_arrow(self, back: int, ahead: int, step: Callable[[pa.Table], dict[str, pa.Array]], fields: Sequence[str]) -> Lane:
        """Add the double columns ``fields`` that ``step`` makes of the ordered rows of a key or block with its neighbours."""
        df = self.df if self.whole else self._lent(back, ahead)
        kept = StructType([f for f in df.schema.fields if f.name not in (BLK, "_own")])
        order = [(c, "ascending") for c in (self.order if self.whole else [POS])]
        whole = self.whole

        def run(rows: pa.Table) -> pa.Table:
            rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
            made = step(rows)
            out = rows.select(kept.names)
            for name in fields:
                out = out.append_column(name, made[name])
            return out if whole else out.filter(rows.column("_own"))

        schema = StructType([*kept.fields, *[StructField(name, DoubleType()) for name in fields]])
        return self._next(df.groupBy(*self.keys, *([] if whole else [BLK])).applyInArrow(run, schema))

    def _lent(self, back: int, ahead: int) -> DataFrame:
        """Rows with their block ``BLK``, and the neighbours lent to a block (``_own`` false)."""
        df = self.df
        if max(back, ahead) > self.block:
            raise ValueError("frame is wider than a block; use running totals instead")
        at = F.col(POS) - 1
        inside = F.pmod(at, F.lit(self.block))
        own = F.floor(at / self.block).cast("long")
        late, soon = inside >= self.block - back, inside < ahead
        blocks = (
            F.when(late & soon, F.array(own - 1, own, own + 1))
            .when(late, F.array(own, own + 1))
            .when(soon, F.array(own - 1, own))
            .otherwise(F.array(own))
        )
        return df.withColumn(BLK, F.explode(blocks)).withColumn("_own", F.col(BLK) == own)

    # -- running values -----------------------------------------------------

    def running(self, columns: dict[str, tuple[str, str]], following: bool = False) -> Lane:
        """Add running values over all earlier rows and the row itself.

        ``columns`` maps a new name to ``(kind, column)`` with kind one of
        ``sum count max min last``. ``following`` runs over later rows instead;
        ``last`` then means the nearest non-null value at or after the row.
        """
        # Later rows are earlier rows of the reversed order: growing frames are linear in
        # the rows, shrinking ones are not.
        span = (Window.unboundedPreceding, 0)
        if self.whole:
            order = [F.desc(c) for c in self.order] if following else self.order
            spec = Window.partitionBy(*self.keys).orderBy(*order).rowsBetween(*span)
            out = {n: _fold(kind, F.col(c)).over(spec) for n, (kind, c) in columns.items()}
            return self._next(self.df.withColumns(out))
        blocked = self.df.withColumn(BLK, F.floor((F.col(POS) - 1) / self.block).cast("long"))
        at, by = (F.desc(POS), F.desc(BLK)) if following else (F.col(POS), F.col(BLK))
        spec = Window.partitionBy(*self.keys, BLK).orderBy(at).rowsBetween(*span)
        inner = blocked.withColumns({n: _fold(kind, F.col(c)).over(spec) for n, (kind, c) in columns.items()})
        totals = blocked.groupBy(*self.keys, BLK).agg(
            *[_total(kind, c, following).alias(f"_t_{n}") for n, (kind, c) in columns.items()]
        )
        outer = Window.partitionBy(*self.keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            *self.keys,
            BLK,
            *[
                _fold("sum" if kind == "count" else kind, F.col(f"_t_{n}")).over(outer).alias(f"_o_{n}")
                for n, (kind, _) in columns.items()
            ],
        )
        joined = inner.join(offsets, [*self.keys, BLK], "left")
        out = {n: _merge(kind, F.col(f"_o_{n}"), F.col(n)) for n, (kind, _) in columns.items()}
        joined = joined.withColumns(out).drop(BLK, *[f"_o_{n}" for n in columns])
        return self._next(joined)

    def numbered(self, name: str = POS) -> Lane:
        """Add the 1-based position of each row inside its key."""
        if self.whole:
            return self._next(self.df.withColumn(name, F.row_number().over(self._spec()).cast("long")))
        if name != POS:
            return self._next(self.df.withColumn(name, F.col(POS)))
        return self

    def runs(self, flag: str, name: str) -> Lane:
        """Length, first and last position of the run of equal ``flag`` values each row is in."""
        lane = self.numbered("_at")
        lane = lane.rolling(
            1,
            1,
            lambda w: {
                "_rs": F.when(~F.lag(flag).over(w).eqNullSafe(F.col(flag)), F.col("_at")),
                "_re": F.when(~F.lead(flag).over(w).eqNullSafe(F.col(flag)), F.col("_at")),
            },
        )
        lane = lane.running({f"{name}_start": ("last", "_rs")})
        lane = lane.running({f"{name}_end": ("last", "_re")}, following=True)
        length = F.col(f"{name}_end") - F.col(f"{name}_start") + 1
        df = lane.df.withColumn(f"{name}_length", length).drop("_rs", "_re", "_at")
        return self._next(df)

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> Lane:
        """Row-wise change that keeps keys, order and row count."""
        return self._next(fn(self.df))

    def done(self) -> DataFrame:
        """The table without helper columns."""
        return self.df.drop(POS, ONE)

    def _next(self, df: DataFrame) -> Lane:
        lane = object.__new__(Lane)
        lane.__dict__.update(self.__dict__)
        lane.df = df
        return lane


def _fold(kind: str, column: Column) -> Column:
    if kind == "last":
        return F.last(column, True)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](column)


def _total(kind: str, column: str, following: bool) -> Column:
    if kind != "last":
        return _fold(kind, F.col(column))
    pick = F.min_by if following else F.max_by
    return pick(F.col(column), F.when(F.col(column).isNotNull(), F.col(POS)))


def _merge(kind: str, offset: Column, own: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(offset + own, offset, own)
    if kind == "last":
        return F.coalesce(own, offset)
    return F.greatest(offset, own) if kind == "max" else F.least(offset, own)


def _numbered(df: DataFrame, keys: list[str], order: list[str], bound: int, limit: int) -> DataFrame:
    """Exact positions by range partitions; a partition never holds much more than ``limit`` rows."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * bound // limit))
    cut = df.repartitionByRange(parts, *keys, *order).withColumn("_cut", F.spark_partition_id())
    cut = settle(cut)
    sizes = cut.groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    spec = Window.partitionBy(*keys, "_cut").orderBy(*order)
    return (
        cut.withColumn("_in", F.row_number().over(spec))
        .join(offsets, [*keys, "_cut"])
        .withColumn(POS, F.col("_in") + F.col("_off"))
        .drop("_in", "_off", "_cut")
    )
