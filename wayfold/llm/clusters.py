"""Small numpy helpers for vectors: bounded k-means and padded matrices."""

from __future__ import annotations

import numpy as np


def padded(rows: list, dim: int) -> np.ndarray:
    """Rows of numbers as a matrix; shorter rows end in zeros."""
    m = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    return m


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        d = (x * x).sum(1)[:, None] + (centers * centers).sum(1) - 2 * (x @ centers.T)
    return np.where(np.isnan(d), np.inf, np.maximum(d, 0))


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """At most k centers of the rows of x (at least one): Lloyd's rounds from distinct random rows."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    distinct = np.unique(x, axis=0)
    centers = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = squared_distances(x, centers).argmin(1)
        count = np.bincount(near, minlength=len(centers))
        for j in np.flatnonzero(count):
            centers[j] = x[near == j].mean(0)
    return centers
