"""The canonical long series: one row per (ts, tag)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.plans.attach import attach
from sensorium.plans.lane import Lane
from sensorium.plans.quantiles import quantiles
from sensorium.session import settle


class Series:
    """Long readings ``ts, tag, value`` (+ ``row_index`` as tie-break) with known sizes.

    The size of the biggest tag and the number of tags are read once, by one count
    per tag, and decide how windows, quantiles and joins are carried out.
    """

    def __init__(self, df: DataFrame, tags: int | None = None, tag_rows: int | None = None):
        if "row_index" not in df.columns:
            df = df.withColumn("row_index", F.lit(0).cast("long"))
        self.df = df
        self._tags = tags
        self._tag_rows = tag_rows

    @cached_property
    def _profile(self) -> tuple[int, int]:
        row = (
            self.df.groupBy("tag")
            .count()
            .agg(F.count(F.lit(1)).alias("tags"), F.max("count").alias("rows"))
            .first()
        )
        return int(row["tags"]), int(row["rows"] or 0)

    @property
    def tags(self) -> int:
        """Number of tags."""
        return self._profile[0] if self._tags is None else self._tags

    @property
    def tag_rows(self) -> int:
        """Rows of the biggest tag."""
        return self._profile[1] if self._tag_rows is None else self._tag_rows

    def like(self, df: DataFrame) -> Series:
        """Same tags and at most the same rows per tag, other columns."""
        out = Series.__new__(Series)
        out.df = df
        out._tags, out._tag_rows = self.tags, self.tag_rows
        return out

    def pipe(self, fn: Callable[[DataFrame], DataFrame]) -> Series:
        return self.like(fn(self.df))

    def lane(self, df: DataFrame | None = None) -> Lane:
        """Rows of each tag in time order."""
        return Lane(self.df if df is None else df, ["tag"], ["ts", "row_index"], self.tag_rows)

    def rows_lane(self, rows: DataFrame) -> Lane:
        """One row per timestamp, in time order."""
        return Lane(rows, [], ["ts"])

    def quantiles(
        self, wanted: dict[str, tuple[str, float]], df: DataFrame | None = None, extra: Sequence[Column] = ()
    ) -> DataFrame:
        """Exact quantiles per tag."""
        return quantiles(self.df if df is None else df, ["tag"], wanted, self.tag_rows, extra=extra)

    def stored(self) -> Series:
        """The same series read back from shared storage, for several passes over a derived shape."""
        out = Series(settle(self.df), self._tags, self._tag_rows)
        return out

    def attach(self, per_tag: DataFrame, df: DataFrame | None = None, how: str = "left") -> DataFrame:
        """Join one row per tag to every reading.

        The per-tag table is written down first: later passes over the readings then
        start from it instead of computing it again, so passes add up, not multiply.
        """
        return attach(self.df if df is None else df, settle(per_tag), "tag", self.tags, how)
