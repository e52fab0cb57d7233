"""Framed medians of ordered rows in numpy, for rows that Spark has cut into blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Frames sorted at once.
ROWS = 8192
_NONE = np.iinfo(np.int64).max


class Held:
    """A double column with missing values; NaN is a value, and the largest."""

    def __init__(self, value: np.ndarray, there: np.ndarray) -> None:
        self.value, self.there = value, there

    @classmethod
    def of(cls, column: pa.ChunkedArray) -> Held:
        there = column.is_valid().to_numpy()
        return cls(column.cast(pa.float64()).fill_null(0.0).to_numpy(), there)

    def arrow(self) -> pa.Array:
        return pa.array(self.value, pa.float64(), mask=~self.there)

    def __sub__(self, other: Held) -> Held:
        with np.errstate(invalid="ignore", over="ignore"):
            return Held(self.value - other.value, self.there & other.there)

    def __abs__(self) -> Held:
        return Held(np.abs(self.value), self.there)

    def before(self) -> Held:
        """The value one row earlier."""
        return Held(np.concatenate([self.value[:1], self.value[:-1]]), np.concatenate([[False], self.there[:-1]])[: len(self.there)])


def nothing(rows: int) -> Held:
    return Held(np.zeros(rows), np.zeros(rows, bool))


def _flip(bits: np.ndarray) -> np.ndarray:
    """Doubles' bits as whole numbers of the same order, and back."""
    return bits ^ ((bits >> 63) & _NONE)


def framed_median(held: Held, back: int, ahead: int, least: int) -> Held:
    """Exact median of the rows from ``back`` before to ``ahead`` after; missing while there are fewer than ``least``."""
    rows, width = len(held.value), back + 1 + ahead
    bits = np.where(np.isnan(held.value), np.nan, held.value + 0.0).view(np.int64)
    key = np.full(rows + width - 1, _NONE)
    key[back : back + rows] = np.where(held.there, _flip(bits), _NONE)
    total = np.concatenate([[0], np.cumsum(key != _NONE)])
    count = total[width:] - total[:rows]
    out = np.zeros(rows)
    frames = np.lib.stride_tricks.sliding_window_view(key, width)
    with np.errstate(invalid="ignore", over="ignore"):
        for at in range(0, rows, ROWS):
            n = np.maximum(count[at : at + ROWS], 1)[:, None]
            some = np.sort(frames[at : at + ROWS], axis=1)
            low, high = (_flip(np.take_along_axis(some, k, 1)[:, 0]).view(np.float64) for k in ((n - 1) // 2, n // 2))
            out[at : at + ROWS] = (low + high) / 2
    return Held(out, count >= max(least, 1))
