"""Sums of vectors over a table: a task adds up its own, groups of tasks are added before the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def sum_vectors(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``of(batch)``, vectors of ``size`` doubles, over all Arrow batches of ``df``."""
    def fold(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def merge(batches):
        total = np.zeros(size)
        for b in batches:
            for raw in b.column("v").to_pylist():
                total += np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    parts, tasks = df.mapInArrow(fold, "v binary"), df.rdd.getNumPartitions()
    if tasks > 64:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(merge, "v binary")
    return sum((np.frombuffer(r.v) for r in parts.collect()), np.zeros(size))


def rows_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """An array column of one length as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def minimise(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int = 200, tol: float = 1e-9,
             memory: int = 10) -> tuple[np.ndarray, float, int]:
    """Limited-memory quasi-Newton steps with a line search that asks for enough decrease; each evaluation is
    one pass over the data. Ends when the objective no longer falls by ``tol`` of itself."""
    x, (f, g) = start, value_and_gradient(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(1, max_iter + 1):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            q -= a * y
            alphas.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        slope = -(q @ g)
        if slope >= 0:  # no way down any more
            return x, f, n
        step = 1.0 if pairs else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        while True:
            new = x - step * q
            f_new, g_new = value_and_gradient(new)
            if f_new <= f + 1e-4 * step * slope or step < 1e-12:
                break
            step *= 0.5
        s, y = new - x, g_new - g
        if y @ s > 1e-12 * (y @ y):
            pairs = [*pairs[-memory + 1:], (s, y)]
        fell = f - f_new
        x, f, g = new, f_new, g_new
        if fell <= tol * max(abs(f), 1.0):
            return x, f, n
    return x, f, max_iter


def minimise_side_by_side(along: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, max_iter: int,
                          tol: float, memory: int = 10) -> tuple[np.ndarray, np.ndarray, int]:
    """Limited-memory quasi-Newton steps for several functions at once, one a column of ``start``. ``along(x, d, steps)``,
    one pass over the rows, has the values (steps x columns) and gradients (steps x rows x columns) at ``x + step * d``,
    ``steps`` (steps x columns) being tried together: each column takes its best and stops by itself. Returns (the lowest
    points, values, passes)."""
    size, k = start.shape
    tried = np.array([4.0, 2.0, 1.0, 0.5, 0.25, 0.1, 0.02])
    values, grads = along(start, np.zeros_like(start), np.zeros((1, k)))
    x, f, g = start.copy(), values[0].copy(), grads[0].copy()
    pairs: list[list] = [[] for _ in range(k)]
    scale, misses, going, passes, since = np.ones(k), np.zeros(k, int), np.ones(k, bool), 1, [[v] for v in f]
    for _ in range(max_iter):
        d = np.zeros_like(x)
        for j in np.flatnonzero(going):
            q, alphas = g[:, j].copy(), []
            for s, y in reversed(pairs[j]):
                a = (s @ q) / (y @ s)
                q -= a * y
                alphas.append(a)
            if pairs[j]:
                s, y = pairs[j][-1]
                q *= (s @ y) / (y @ y)
            else:
                q /= max(np.linalg.norm(q), 1e-12)
            for (s, y), a in zip(pairs[j], reversed(alphas)):
                q += s * (a - (y @ q) / (y @ s))
            d[:, j] = -q
        steps = tried[:, None] * scale
        values, grads = along(x, d, steps)
        passes += 1
        for j in np.flatnonzero(going):
            best = int(values[:, j].argmin())
            if values[best, j] < f[j]:
                s, y = steps[best, j] * d[:, j], grads[best][:, j] - g[:, j]
                if y @ s > 1e-12 * (y @ y):
                    pairs[j] = [*pairs[j][-memory + 1:], (s, y)]
                x[:, j], f[j], g[:, j] = x[:, j] + s, values[best, j], grads[best][:, j]
                scale[j], misses[j] = 1.0, 0
                since[j].append(f[j])
                going[j] = len(since[j]) <= 5 or since[j][-6] - f[j] > tol * max(abs(f[j]), 1e-12)
            else:  # no way down with these steps: shorter ones, then straight down
                misses[j] += 1
                scale[j] *= 0.01
                if misses[j] == 2:
                    pairs[j], scale[j] = [], 0.1
                going[j] = misses[j] < 4
        if not going.any():
            break
    return x, f, passes
