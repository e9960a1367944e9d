"""Counts, means and co-moments of all pairs of columns in one pass.

A task folds its rows into matrices of d x d numbers, block by block, with NULL and NaN left out pair
by pair; blocks and tasks are merged by the update rule for means and co-moments, so nothing cancels.
What leaves a task is one row of 5 d^2 doubles; they are merged in groups before the driver sees them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exprs import number

BLOCK = 4096


class Moments:
    """Of each pair (i, j) over rows that have both: ``n``, the mean and the sum of squared deviations of
    column i (``mean[i, j]``, ``square[i, j]``), and the sum of products of deviations (``product``)."""

    def __init__(self, d: int):
        self.n, self.mean, self.square, self.product = (np.zeros((d, d)) for _ in range(4))

    @staticmethod
    def of(x: np.ndarray) -> "Moments":
        out = Moments(x.shape[1])
        there = ~np.isnan(x)
        shift = np.where(there.any(axis=0), np.nanmean(np.where(there.any(axis=0), x, 0.0), axis=0), 0.0)
        z, m = np.where(there, x - shift, 0.0), there.astype(float)
        out.n = m.T @ m
        safe = np.maximum(out.n, 1)
        total = z.T @ m  # of column i over rows that have j
        mean = total / safe
        out.mean = np.where(out.n > 0, mean + shift[:, None], 0.0)
        out.square = np.maximum((z * z).T @ m - out.n * mean * mean, 0.0)
        out.product = z.T @ z - out.n * mean * mean.T
        return out

    def add(self, other: "Moments") -> None:
        n = self.n + other.n
        safe = np.maximum(n, 1)
        d = other.mean - self.mean
        both = self.n * other.n / safe
        self.square += other.square + d * d * both
        self.product += other.product + d * d.T * both
        self.mean = np.where(n > 0, self.mean + d * other.n / safe, 0.0)
        self.n = n

    def to_bytes(self) -> bytes:
        return np.stack([self.n, self.mean, self.square, self.product]).tobytes()

    @staticmethod
    def from_bytes(raw: bytes, d: int) -> "Moments":
        out = Moments(d)
        out.n, out.mean, out.square, out.product = np.frombuffer(raw).reshape(4, d, d).copy()
        return out

    def correlation(self) -> np.ndarray:
        """NaN where a column does not vary or fewer than two rows have both."""
        scale = np.sqrt(self.square * self.square.T)
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.where((self.n > 1) & (scale > 0), self.product / scale, np.nan)
        return np.clip(r, -1.0, 1.0)


def moments(df: DataFrame, cols: list[str], complete: bool = False) -> Moments:
    """``complete``: only rows without a missing value in any of the columns."""
    d = len(cols)
    vec = df.select(F.array(*[F.coalesce(number(c), F.lit(float("nan"))) for c in cols]).alias("vec"))

    def fold(batches):
        held = Moments(d)
        for b in batches:
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            if complete:
                x = x[~np.isnan(x).any(axis=1)]
            for a in range(0, len(x), BLOCK):
                held.add(Moments.of(x[a:a + BLOCK]))
        if held.n.any():
            yield pa.RecordBatch.from_arrays([pa.array([held.to_bytes()], pa.binary())], names=["m"])

    def merge(batches):
        held = Moments(d)
        for b in batches:
            for raw in b.column("m").to_pylist():
                held.add(Moments.from_bytes(raw, d))
        if held.n.any():
            yield pa.RecordBatch.from_arrays([pa.array([held.to_bytes()], pa.binary())], names=["m"])

    parts = vec.mapInArrow(fold, "m binary")
    tasks = vec.rdd.getNumPartitions()
    if tasks > 64:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(merge, "m binary")
    out = Moments(d)
    for r in sorted(parts.collect(), key=lambda r: bytes(r.m)):  # any order, but the same each time
        out.add(Moments.from_bytes(r.m, d))
    return out
