"""Small models fitted on bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Labelled rows that a model is fitted on, at most: those of the lowest hashes of their keys.
LABELLED = 20_000


def remainder(key: str, parts: int):
    """crc32 of the key as text, modulo ``parts``; null keys give null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, keep, bound: int = LABELLED) -> DataFrame:
    """(id, text, y) of at most ``bound`` labelled rows that fulfil ``keep``; the same rows whatever the partitions."""
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & keep)
        .groupBy(F.col(key).alias("id")).agg(F.max(F.col(label)).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(bound)
    )
    # at most ``bound`` rows of 12 bytes
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "y")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Coefficients that minimise the logistic loss of x against y in {0, 1} plus a ridge penalty, by Newton's method."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * (w @ w) / 2)

    best = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step, rate = np.linalg.solve(curve, slope), 1.0
        while rate > 1e-6 and (now := loss(w - rate * step)) > best:
            rate /= 2
        if rate <= 1e-6 or best - now < 1e-9 * (1 + best):
            break
        w, best = w - rate * step, now
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
