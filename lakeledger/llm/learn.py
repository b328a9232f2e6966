"""Small numeric tools for models that are fitted on a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def bucket_of(key: str, buckets: int) -> Column:
    """crc32 of the key as text, modulo ``buckets``: the folds that decide what a model may learn from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % buckets


def labelled_sample(labels: DataFrame, usable: Column, per_class: int, key: str, label: str) -> tuple[DataFrame, dict]:
    """(key, label) of at most ``per_class`` rows of each class in hash order, and the number of usable rows by class.

    A key with several labels counts with the largest one. The sample is a few thousand rows whatever the table's
    size, so it may be broadcast.
    """
    one = labels.filter(usable & F.col(label).isin(0, 1) & F.col(key).isNotNull())
    one = one.groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    counts = {row["_label"]: row["count"] for row in one.groupBy("_label").count().collect()}
    order = [F.xxhash64(key), F.col(key)]
    parts = [one.filter(F.col("_label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def ascend(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float = 0.1) -> np.ndarray:
    """Adam on a (noise-free) gradient, with a step length that falls to a tenth."""
    x, first, second = start.astype(float).copy(), np.zeros(len(start)), np.zeros(len(start))
    for t in range(1, steps + 1):
        g = gradient(x)
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        x += rate * 0.1 ** (t / steps) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return x


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression; the last column of ``x`` is the constant."""
    weight = weight / weight.sum()

    def gradient(w: np.ndarray) -> np.ndarray:
        return x.T @ (weight * (y - sigmoid(x @ w))) - ridge * w

    return ascend(gradient, np.zeros(x.shape[1]), steps)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y on x by pooling adjacent violators; equal x are pooled first."""
    places, inverse = np.unique(x, return_inverse=True)
    mass = np.bincount(inverse, weight)
    mean = np.bincount(inverse, weight * y) / mass
    blocks: list[list[float]] = []                     # mean, mass, first place, last place
    for value, w, at in zip(mean, mass, places):
        blocks.append([value, w, at, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            later, earlier = blocks.pop(), blocks[-1]
            total = earlier[1] + later[1]
            earlier[0] = (earlier[0] * earlier[1] + later[0] * later[1]) / total
            earlier[1], earlier[3] = total, later[3]
    knots = np.array([[b[2], b[0]] for b in blocks] + [[b[3], b[0]] for b in blocks])
    knots = knots[np.lexsort((knots[:, 1], knots[:, 0]))]
    return knots[:, 0], knots[:, 1]
