"""Labelled training rows within a documented bound, and the logistic calibration of a few figures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(id_text: Column, folds: int) -> Column:
    return F.crc32(id_text.cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, limit: int) -> DataFrame:
    """(key, text, y) of at most `limit` labelled rows outside fold `held`, those with the smallest hashes of their ids.

    The sample's ids are broadcast: their number is bounded by `limit`. A document with several labels takes the largest.
    """
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("string").alias("id_text"), F.col(label).cast("int").alias("y"))
    ids = ids.filter(fold_of(F.col("id_text"), folds) != held).groupBy("id_text").agg(F.max("y").alias("y"))
    ids = ids.orderBy(F.xxhash64("id_text"), "id_text").limit(limit)
    return docs.join(F.broadcast(ids), "id_text").select("key", "text", "y")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights, intercept last, of a ridge logistic regression by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty @ w
        hess = (a * (p * (1 - p))[:, None]).T @ a + penalty
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
