"""Joins of a big table with small ones; a side is broadcast only after its size is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorium.session import small_rows


def attach(big: DataFrame, small: DataFrame, on: Sequence[str] | str, rows: int | None, how: str = "left") -> DataFrame:
    """Join ``small`` to ``big``; ``rows`` is a proven upper bound of its size, or None.

    Without a bound, or beyond the limit, the join is left to the planner, which
    re-plans on run-time sizes and splits skewed keys.
    """
    if rows is not None and rows <= small_rows(big.sparkSession):
        small = F.broadcast(small)
    return big.join(small, on, how)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row table (a grand total) next to every row, as literals."""
    row = one_row.first()
    types = {f.name: f.dataType for f in one_row.schema.fields}
    return df.withColumns({name: F.lit(row[name]).cast(kind) for name, kind in types.items()})
