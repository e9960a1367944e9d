"""Probabilities from the margins of one-vs-rest classifiers.

All classes are calibrated together: ``p = softmax(a_k m_k + b_k)`` with a slope and an offset for each
class, by Newton steps on the log-loss. A step's gradient and Hessian are one pass over the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sums import rows_of, sum_vectors

RIDGE = 1e-6
MAX_STEPS = 50


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_calibration(rows: DataFrame, classes: int, margins: str = "margins", label: str = "label",
                    weight: str | None = None) -> dict:
    """``rows``: margins as an array of ``classes`` doubles and the class index as a double; a row counts as ``weight`` rows."""
    k = classes
    theta = np.concatenate([np.ones(k), np.zeros(k)])

    def terms(theta):
        def of(batch):
            m, y = rows_of(batch, margins), batch.column(label).to_numpy(zero_copy_only=False).astype(int)
            n = batch.column(weight).to_numpy(zero_copy_only=False) if weight else np.ones(len(y))
            p = _softmax(m * theta[:k] + theta[k:])
            d = p.copy()
            d[np.arange(len(y)), y] -= 1
            d *= n[:, None]
            grad = np.concatenate([(d * m).sum(axis=0), d.sum(axis=0)])
            hess = np.zeros((2 * k, 2 * k))
            w = -np.einsum("ni,nj->nij", p, p)
            w[:, np.arange(k), np.arange(k)] += p
            w *= n[:, None, None]
            hess[:k, :k] = np.einsum("nij,ni,nj->ij", w, m, m)
            hess[:k, k:] = np.einsum("nij,ni->ij", w, m)
            hess[k:, :k] = hess[:k, k:].T
            hess[k:, k:] = w.sum(axis=0)
            loss = -(n * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
            return np.concatenate([[loss, n.sum()], grad, hess.ravel()])

        v = sum_vectors(rows, of, 2 + 2 * k + 4 * k * k)
        n = max(v[1], 1.0)
        penalty = RIDGE * (theta - np.concatenate([np.ones(k), np.zeros(k)]))
        loss = v[0] / n + 0.5 * RIDGE * float(((theta - np.concatenate([np.ones(k), np.zeros(k)])) ** 2).sum())
        return loss, v[2:2 + 2 * k] / n + penalty, v[2 + 2 * k:].reshape(2 * k, 2 * k) / n + RIDGE * np.eye(2 * k), v[0] / n

    loss, grad, hess, plain = terms(theta)
    for _ in range(MAX_STEPS):
        step, t = np.linalg.solve(hess, grad), 1.0
        while True:
            new = theta - t * step
            found = terms(new)
            if found[0] <= loss or t < 1e-6:
                break
            t *= 0.5
        fell = loss - found[0]
        theta, (loss, grad, hess, plain) = new, found
        if fell <= 1e-10 * max(loss, 1e-10):
            break
    return {"slope": theta[:k].tolist(), "offset": theta[k:].tolist(), "log_loss": float(plain)}


def probabilities(margins: Column, fitted: dict) -> Column:
    """The array of class probabilities of a margin array."""
    slope, offset = (F.array(*[F.lit(float(v)) for v in fitted[c]]) for c in ("slope", "offset"))
    scores = F.zip_with(F.zip_with(margins, slope, lambda m, a: m * a), offset, lambda m, b: m + b)
    shifted = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, e: a + e)
    return F.transform(shifted, lambda e: e / total)
