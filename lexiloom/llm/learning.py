"""What the trained operators share: folds by id, bounded samples, logistic models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def sample(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The ``n`` rows whose keys have the least hash: the same ones wherever they lie."""
    return rows.orderBy(F.xxhash64(*keys), *keys).limit(n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 200) -> np.ndarray:
    """Weights (the last for a constant) by accelerated full-batch descent on the ridge-penalised log loss."""
    n, k = x.shape
    weight = np.ones(n, np.float32) if weight is None else weight.astype(np.float32)
    x = np.hstack([x, np.ones((n, 1), np.float32)]).astype(np.float32)
    penalty = np.full(k + 1, ridge, np.float32)
    penalty[-1] = 0
    # the largest curvature, by a few rounds of the power method
    v = np.ones(k + 1, np.float32) / np.sqrt(k + 1)
    for _ in range(12):
        v = x.T @ (weight * (x @ v))
        size = np.linalg.norm(v)
        v /= max(size, 1e-9)
    rate = 1 / (0.26 * size + ridge)
    w = last = np.zeros(k + 1, np.float32)
    for t in range(steps):
        ahead = w + (t / (t + 3)) * (w - last)
        grad = x.T @ (weight * (sigmoid(x @ ahead) - y).astype(np.float32)) + penalty * ahead
        last, w = w, ahead - rate * grad
    return w


def apply_logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
