"""Whitening of embeddings by a bidiagonal qd solver.

The tasks centre their rows and reduce them, block by block, to one triangular factor R
of the whole table (R'R is n times the covariance); R is as wide as a vector, whatever
the number of rows. R is brought to bidiagonal form by Householder reflections, the
differential qd algorithm finds its singular values to high relative accuracy, and
twisted factorisations give a direction for each without forming a covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorium.llm.base import pick

EPS = np.finfo(float).eps
#: Fixed values of the integer scale.
STEPS, SHIFT = 1024, 100_000
#: Entries beyond this, times STEPS, are taken for it.
FAR = float(2**52)
#: Rows of a block that is reduced at once, at least; wider vectors take more.
ROWS = 2048
#: Singular values nearer than this, relative to the larger, share a cluster.
NEAR = 1e-7


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of an upper bidiagonal U'RV, and V."""
    a = np.array(r, float)
    d = len(a)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        scale = np.abs(x).max(initial=0.0)
        if scale == 0 or len(x) == 1:
            return np.zeros_like(x), 0.0
        w = x / scale
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w, 2.0 / (w @ w)

    for k in range(d):
        w, beta = reflector(a[k:, k].copy())
        a[k:, k:] -= beta * np.outer(w, w @ a[k:, k:])
        if k + 1 < d:
            w, beta = reflector(a[k, k + 1 :].copy())
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= beta * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _transform(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One differential qd step with a shift; None where it leaves the positive numbers."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    least = d
    for k in range(n - 1):
        if d < 0:
            return None
        top = d + e[k]
        if top == 0:
            return None
        ratio = q[k + 1] / top
        new_q[k], new_e[k] = top, e[k] * ratio
        d = d * ratio - shift
        least = min(least, d)
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e, least


def qd_values(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal with squared entries ``q`` > 0 and ``e`` >= 0, falling."""
    found: list[float] = []
    todo = [(np.array(q, float), np.array(e, float), 0.0, 0.0)]
    while todo:
        q, e, total, guess = todo.pop()
        if len(q) == 1:
            found.append(float(q[0] + total))
            continue
        cut = np.flatnonzero(e <= EPS * EPS * (total + np.minimum(q[:-1], q[1:])))
        if len(cut):
            at = int(cut[-1]) + 1
            todo.append((q[:at], e[: at - 1], total, 0.0))
            todo.append((q[at:], e[at:], total, 0.0))
            continue
        if q[-1] > 1.5 * q[0]:
            q, e = q[::-1], e[::-1]
            guess = 0.0
        for shift in (guess, guess * 0.75, guess * 0.25, 0.0):
            # a shift too small to change the sum only costs accuracy
            step = _transform(q, e, shift if total + shift > total else 0.0)
            if step is not None:
                break
        if step is None:
            # no shift works only where a pivot is exactly zero
            q = np.maximum(q, np.finfo(float).tiny)
            step = _transform(q, np.maximum(e, np.finfo(float).tiny), 0.0)
        new_q, new_e, least = step
        # near the end the last pivot is the value but for its coupling
        rest = new_e[-1] / (1.0 + new_e[-1] / new_q[-2]) if new_q[-2] > 0 else 0.0
        last = max(new_q[-1] - rest, 0.0) if least == new_q[-1] else 0.5 * max(least, 0.0)
        todo.append((new_q, new_e, total + (shift if total + shift > total else 0.0), last))
    return np.sort(np.array(found))[::-1]


def twisted(q: np.ndarray, l: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers from the top and the bottom of LDL' - value, and the twist pivots."""
    n = len(q)
    tiny = np.finfo(float).tiny
    up, down, s, p = np.empty(n - 1), np.empty(n - 1), np.empty(n), np.empty(n)
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + q[k]
        pivot = pivot if abs(pivot) > tiny else -EPS * value
        up[k] = q[k] * l[k] / pivot
        s[k + 1] = up[k] * l[k] * s[k] - value
    p[-1] = q[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = q[k] * l[k] * l[k] + p[k + 1]
        pivot = pivot if abs(pivot) > tiny else -EPS * value
        ratio = q[k] / pivot
        down[k] = l[k] * ratio
        p[k] = p[k + 1] * ratio - value
    return up, down, s + p + value


def direction(up: np.ndarray, down: np.ndarray, twist: int) -> np.ndarray:
    """The vector that a twist at this place gives, of unit length."""
    z = np.zeros(len(up) + 1)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -up[k] * z[k + 1]
    for k in range(twist, len(up)):
        z[k + 1] = -down[k] * z[k]
    top = np.abs(z).max()
    z = z / top
    return z / np.linalg.norm(z)


def leading(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest squared singular values of R (at most ``count``, positive ones only) and their right vectors as columns."""
    scale = np.abs(r).max(initial=0.0)
    if scale == 0:
        return np.empty(0), np.empty((len(r), 0))
    a, b, v = bidiagonal(r / scale)
    # pivots of zero would stop the recurrences; so small a change is below rounding
    floor = EPS * EPS * max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    a = np.where(np.abs(a) < floor, floor, a)
    q, e = a * a, b * b
    values = qd_values(q, e)
    values = values[values > (len(r) * EPS) ** 2 * values[0]][:count]
    l = b / a[:-1]
    out: list[np.ndarray] = []
    for k, value in enumerate(values):
        near = [j for j in range(k) if values[j] - value <= NEAR * values[j]]
        up, down, pivot = twisted(q, l, value)
        z = direction(up, down, int(np.argmin(np.abs(pivot))))
        if near:
            # a cluster: of the twists, the one that adds most to the space found so far, then inverse iteration
            have = np.stack([out[j] for j in near], 1)
            tries = [direction(up, down, int(t)) for t in np.argsort(np.abs(pivot))[: 4 * (len(near) + 1)]]
            tries = [t - have @ (have.T @ t) for t in tries]
            z = max(tries, key=np.linalg.norm)
            if np.linalg.norm(z) < 1e-3:
                z = np.random.default_rng(k).normal(size=len(q))
            full = np.diag(q + np.concatenate([[0.0], e])) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
            full[np.diag_indices(len(q))] -= value * (1 + 8 * EPS)
            for _ in range(3):
                z = z - have @ (have.T @ z)
                z = np.linalg.solve(full, z / np.linalg.norm(z))
            z = z - have @ (have.T @ z)
            z = z - have @ (have.T @ z)
            z /= np.linalg.norm(z)
        out.append(z)
    vectors = v @ np.stack(out, 1)
    sign = np.sign(vectors[np.argmax(np.abs(vectors), 0), np.arange(vectors.shape[1])])
    return values * scale * scale, vectors * np.where(sign == 0, 1.0, sign)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch (all of one length) as whole numbers."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float)
    x = np.clip(np.floor(flat * STEPS), -FAR, FAR).astype(np.int64) + SHIFT
    return x.reshape(batch.num_rows, -1)


@dataclass
class Centre:
    """Number of rows and exact sums per dimension."""

    n: int
    sums: list[int]

    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    def part(self) -> np.ndarray:
        return np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n with one rounding."""
        return (x - self.whole()) - self.part()

    def deviation(self, x: np.ndarray) -> np.ndarray | list:
        """Sum of (n x - S)^2 per row, exact; None where it passes 64 bits."""
        rest = np.array([s % self.n for s in self.sums], np.int64)
        d = x - self.whole()
        most = self.n * (float(np.abs(d).max(initial=0)) + 1.0)
        if most * most * x.shape[1] < 2.0**62:
            y = self.n * d - rest
            return (y * y).sum(1)
        # n x - S = n d - rest: the square sums of d, d * rest and rest, as Python numbers
        d = d.astype(object)
        total = (self.n * d - rest.astype(object)) ** 2
        return [int(t) if t < 2**63 else None for t in total.sum(1)]


def triangle(blocks: Iterator[np.ndarray], width: int) -> np.ndarray | None:
    """R of all rows of the blocks; a row space of ``width`` is kept, never more."""
    size = max(ROWS, 2 * width)
    held, rows, found = [], 0, False

    def reduce() -> np.ndarray:
        r = np.linalg.qr(np.concatenate(held), mode="r")
        return r if len(r) == width else np.concatenate([r, np.zeros((width - len(r), width))])

    for block in blocks:
        for at in range(0, len(block), size):
            held.append(block[at : at + size])
            rows += len(held[-1])
            found = True
            if rows >= size:
                held, rows = [reduce()], width
    return reduce() if found else None


def valid(df: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int, int]:
    """Vectors without null or non-finite entries, of the commonest length (ties: the shortest); their number and length."""
    rows = pick(df, vec_id=id_column, vector=vector_column)
    rows = rows.select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & good)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return rows, 0, 0
    return rows.where(F.size("vector") == sizes["d"]), int(sizes["n"]), int(sizes["d"])


def centre(rows: DataFrame, n: int, width: int) -> Centre:
    """Exact sums: every task adds up the high and low halves of its numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                high += (x >> 32).sum(0)
                low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(high), pa.array(low)], ["at", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    sums = rows.select("vector").mapInArrow(run, "at int, high long, low long").groupBy("at").agg(wide("high"), wide("low")).collect()
    total = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) for r in sums}
    return Centre(n, [total[k] for k in range(width)])


def factor(rows: DataFrame, middle: Centre, width: int) -> np.ndarray:
    """R of the centred table: each task reduces its rows, then fewer tasks reduce what is left."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack(triangle((middle.centred(matrix(b)) for b in batches if b.num_rows), width))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.frombuffer(v, "<f8").reshape(width, width) for b in batches for v in b.column("r").to_pylist())
        yield from pack(triangle(held, width))

    def pack(r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.astype("<f8").tobytes()], pa.binary())], ["r"])

    kind = "r binary"
    parts = rows.select("vector").mapInArrow(first, kind)
    fewer = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    # a task holds one R and the next one
    last = parts.repartition(fewer).mapInArrow(again, kind).repartition(1).mapInArrow(again, kind).collect()
    return np.frombuffer(last[0]["r"], "<f8").reshape(width, width)


def whiten(df: DataFrame, count: int = 8, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Whitened coordinates of every vector on the ``count`` leading components.

    Result: ``vec_id, component, n, deviation, whitened, explained, identity_error``, one row
    per vector and component (as many as dimensions, if those are fewer). Vectors that are
    null, empty or hold null or non-finite entries take no part, nor do those of another
    length than the commonest one (ties: the shortest). Entries become whole numbers
    ``floor(1024 c) + 100000``, those beyond 2^42 the last such number. Repeated ids are rows of their own.
    Components without variance (fewer distinct vectors than dimensions) have null
    coordinates and explain 0; then the identity error is that of the others, 0 without
    any. ``deviation`` is null where it passes 64 bits. Each component's largest entry is positive.
    An empty table gives no rows. The vector's length, squared, has to fit into a task.
    """
    spark = df.sparkSession
    rows, n, width = valid(df, id_column, vector_column)
    id_kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if n == 0:
        return spark.createDataFrame([], schema)
    middle = centre(rows, n, width)
    r = factor(rows, middle, width)
    values, vectors = leading(r, min(count, width))
    total = float((r * r).sum())
    shown, kept = min(count, width), len(values)
    turn = vectors / np.sqrt(values / n) if kept else np.empty((width, 0))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, product = np.zeros(kept), np.zeros((kept, kept))
        for batch in batches:
            if batch.num_rows:
                w = middle.centred(matrix(batch)) @ turn
                mean += w.sum(0)
                product += w.T @ w
        flat = np.concatenate([mean, product.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "v"])

    error = 0.0
    if kept:
        held = rows.select("vector").mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        flat = np.array([r["v"] for r in sorted(held, key=lambda r: r["at"])]) / n
        error = float(np.abs(flat[kept:].reshape(kept, kept) - np.outer(flat[:kept], flat[:kept]) - np.eye(kept)).max())
    explained = np.concatenate([values / total, np.zeros(shown - kept)]) if kept else np.zeros(shown)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch)
            w = np.full((m, shown), np.nan)
            w[:, :kept] = middle.centred(x) @ turn
            again = np.repeat(np.arange(m), shown)
            white = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * shown, n)),
                    pa.array(middle.deviation(x), pa.int64()).take(pa.array(again)),
                    white,
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * shown, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
