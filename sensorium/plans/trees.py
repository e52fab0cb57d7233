"""Small learners on the rows of one target: binned regression trees, boosting, and linear paths.

A task holds at most a stated number of rows of a target, so that a learner sees them at
once; targets, and shares of a forest, are spread by Spark (``operators.models``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """Cuts of each column between its distinct values, at most BINS - 1, at equal shares of the rows."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="lower"))
            out.append(values)
        else:
            out.append((values[:-1] + values[1:]) / 2)
    return out


def bin_codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1) if x.shape[1] else np.zeros(x.shape, int)


@dataclass
class Tree:
    """A complete tree as a heap: split column (-1: none), its last code on the left, and the value of every node."""

    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def walk(self, codes: np.ndarray, parts: np.ndarray | None = None) -> np.ndarray:
        """Value of each row's leaf; ``parts`` gathers what each column's splits moved the value by."""
        node = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        while node[0] < len(self.column) if len(node) else False:
            column = self.column[node]
            right = (column >= 0) & (codes[rows, np.maximum(column, 0)] > self.cut[node])
            below = 2 * node + 1 + right
            if parts is not None:
                parts[rows, np.maximum(column, 0)] += np.where(column >= 0, self.value[below] - self.value[node], 0.0)
            node = below
        return self.value[node]


def grow(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int, penalty: float = 0.0, columns: np.ndarray | None = None) -> tuple[Tree, np.ndarray]:
    """A least-squares tree, all nodes of a level from one histogram, and each column's gain.

    A split needs rows on both sides; equal gains go to the first column and the smallest cut.
    ``penalty`` shrinks values and gains as a number of extra rows of value 0 would.
    """
    n, k = codes.shape
    allowed = np.ones(k, bool) if columns is None else columns
    tree = Tree(np.full(2**depth - 1, -1), np.zeros(2**depth - 1, int), np.zeros(2 ** (depth + 1) - 1))
    gains = np.zeros(k)
    node = np.zeros(n, np.int64)
    place = codes + np.arange(k) * BINS
    heavy = np.repeat(weight, k)
    heavy_y = np.repeat(weight * y, k)
    for level in range(depth + 1):
        count = 2**level
        at = count - 1
        own, own_y = np.bincount(node, weight, count), np.bincount(node, weight * y, count)
        mean = own_y / np.where(own + penalty > 0, own + penalty, 1.0)
        if level:
            mean = np.where(own > 0, mean, np.repeat(tree.value[at // 2 : at], 2))
        tree.value[at : at + count] = mean
        if level == depth or not k:
            continue
        cell = (node[:, None] * (k * BINS) + place).ravel()
        w = np.bincount(cell, heavy, count * k * BINS).reshape(count, k, BINS).cumsum(2)
        s = np.bincount(cell, heavy_y, count * k * BINS).reshape(count, k, BINS).cumsum(2)
        rest, rest_y = own[:, None, None] - w, own_y[:, None, None] - s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s * s / (w + penalty) + rest_y * rest_y / (rest + penalty) - (own_y**2 / (own + penalty))[:, None, None]
        gain[(w <= 0) | (rest <= 1e-9) | ~allowed[None, :, None] | np.isnan(gain)] = -1.0
        best = gain.reshape(count, -1).argmax(1)
        top = gain.reshape(count, -1)[np.arange(count), best]
        split = top > 1e-9 * np.maximum(1.0, np.abs(own_y * mean))
        tree.column[at : at + count] = np.where(split, best // BINS, -1)
        tree.cut[at : at + count] = best % BINS
        np.add.at(gains, (best // BINS)[split], top[split])
        column = tree.column[at + node]
        node = 2 * node + ((column >= 0) & (codes[np.arange(n), np.maximum(column, 0)] > tree.cut[at + node]))
    return tree, gains


def forest(codes: np.ndarray, y: np.ndarray, depth: int, seeds: list[int]) -> tuple[list[Tree], np.ndarray]:
    """Trees on bootstrap rows, one per seed; the importance is the mean of the trees' shares of gain."""
    trees, importance = [], np.zeros(codes.shape[1])
    for seed in seeds:
        weight = np.bincount(np.random.default_rng(seed).integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        tree, gains = grow(codes, y, weight, depth)
        trees.append(tree)
        importance += gains / gains.sum() if gains.sum() > 0 else 0.0
    return trees, importance / len(seeds)


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree]

    def predict(self, codes: np.ndarray, parts: np.ndarray | None = None) -> np.ndarray:
        own = np.zeros(codes.shape) if parts is not None else None
        out = self.base + self.rate * sum(t.walk(codes, own) for t in self.trees) if self.trees else np.full(len(codes), self.base)
        if parts is not None:
            parts += self.rate * own
        return out


def boost(codes: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, rows: float, columns: float = 1.0, penalty: float = 0.0, seed: int = 42) -> Boosted:
    """Trees on what is left, each on a share of the rows and columns."""
    rng = np.random.default_rng(seed)
    n, k = codes.shape
    model = Boosted(float(y.mean()), rate, [])
    left = y - model.base
    for _ in range(rounds):
        weight = (rng.permutation(n) < max(1, int(rows * n))).astype(float)
        tree, _ = grow(codes, left, weight, depth, penalty, rng.permutation(k) < max(1, int(columns * k)))
        # as far as the shrunken root goes; each step moves by ``rate``
        left = left - rate * tree.walk(codes)
        model.trees.append(tree)
    return model


def standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = x.std(0)
    return x.mean(0), np.where(scale > 0, scale, 1.0)


def descend(x: np.ndarray, y: np.ndarray, alphas: np.ndarray, mix: float, rounds: int = 1000) -> np.ndarray:
    """Elastic-net weights of centred data for every alpha at once (one row each), by coordinate descent."""
    n, k = x.shape
    cross, target = x.T @ x / n, x.T @ y / n
    w = np.zeros((len(alphas), k))
    for _ in range(rounds):
        before = w.copy()
        for j in range(k):
            pull = target[j] - w @ cross[:, j] + w[:, j] * cross[j, j]
            size = np.maximum(np.abs(pull) - alphas * mix, 0.0)
            scale = cross[j, j] + alphas * (1 - mix)
            w[:, j] = np.where(scale > 0, np.sign(pull) * size / np.where(scale > 0, scale, 1.0), 0.0)
        if np.abs(w - before).max(initial=0.0) <= 1e-6 * max(np.abs(w).max(initial=0.0), 1e-12):
            break
    return w


def folds_of(n: int, folds: int, seed: int | None) -> np.ndarray:
    """Fold of each row: equal runs of rows, of shuffled rows with a seed."""
    fold = np.arange(n) * folds // max(n, 1)
    return fold if seed is None else fold[np.random.default_rng(seed).permutation(n)]


def net(x: np.ndarray, y: np.ndarray, mix: float, folds: int = 3) -> tuple[float, np.ndarray]:
    """Intercept and weights of the elastic net whose alpha has the least squared error over folds."""
    top = np.abs((x - x.mean(0)).T @ (y - y.mean())).max(initial=0.0) / (len(y) * mix)
    alphas = np.maximum(top, 1e-12) * np.logspace(0, -3, 100)
    error = np.zeros(len(alphas))
    fold = folds_of(len(y), folds, None)
    for f in range(folds):
        a, b = fold != f, fold == f
        mean, middle = x[a].mean(0), y[a].mean()
        w = descend(x[a] - mean, y[a] - middle, alphas, mix)
        error += (((y[b] - middle)[:, None] - (x[b] - mean) @ w.T) ** 2).mean(0)
    mean, middle = x.mean(0), y.mean()
    w = descend(x - mean, y - middle, alphas[[error.argmin()]], mix)[0]
    return float(middle - mean @ w), w


def ridge(x: np.ndarray, y: np.ndarray, alphas: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Intercept and weights of the ridge whose penalty has the least leave-one-out error."""
    alphas = np.logspace(-3, 3, 10) if alphas is None else alphas
    mean, middle = x.mean(0), y.mean()
    u, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    uy = u.T @ (y - middle)
    error = []
    for a in alphas:
        share = s * s / (s * s + a)
        hat = (u * u) @ share + 1 / len(y)
        error.append((((y - middle - u @ (share * uy)) / np.maximum(1 - hat, 1e-12)) ** 2).mean())
    w = vt.T @ (s / (s * s + alphas[int(np.argmin(error))]) * uy)
    return float(middle - mean @ w), w
