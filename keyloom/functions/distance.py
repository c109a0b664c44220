"""Distances between the rows of a numpy matrix and a few reference rows; used inside tasks."""

from __future__ import annotations

import numpy as np


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks per row."""
    less = (x[:, :, None] > x[:, None, :]).sum(2)
    ties = (x[:, :, None] == x[:, None, :]).sum(2)
    return less + (ties + 1) / 2


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def _centred(x: np.ndarray) -> np.ndarray:
    return _unit(x - x.mean(1, keepdims=True))


def _pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.clip(_centred(x) @ _centred(y).T, -1, 1)


def _spearman(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _pearson(_ranks(x), _ranks(y))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([((x - row) ** 2).sum(1) for row in y], axis=1)


def _slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of steps with the same direction."""
    a, b = np.sign(np.diff(x, axis=1)), np.sign(np.diff(y, axis=1))
    return np.stack([(a == row).mean(1) for row in b], axis=1)


def _extremes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1, 0.5 or 0: how many of the maximum and minimum positions agree."""
    hi = x.argmax(1)[:, None] == y.argmax(1)[None, :]
    lo = x.argmin(1)[:, None] == y.argmin(1)[None, :]
    return (hi.astype(float) + lo) / 2


def _shape_similarity(correlation: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Half correlation, a quarter slope agreement, a quarter agreement of extremes."""
    return 0.5 * (correlation + 1) / 2 + 0.25 * _slopes(x, y) + 0.25 * _extremes(x, y)


def _jackknife(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest correlation after leaving out any one sample."""
    keep = [np.delete(np.arange(x.shape[1]), i) for i in range(x.shape[1])]
    return np.min([_pearson(x[:, k], y[:, k]) for k in [np.arange(x.shape[1]), *keep]], axis=0)


def _sharpened_cosine(x: np.ndarray, y: np.ndarray, p: float = 3.0, q: float = 1e-1) -> np.ndarray:
    s = (x @ y.T) / ((np.linalg.norm(x, axis=1)[:, None] + q) * (np.linalg.norm(y, axis=1)[None, :] + q))
    return np.sign(s) * np.abs(s) ** p


METRICS = {
    "euclidean": lambda x, y: np.sqrt(_squared(x, y)),
    "sqeuclidean": _squared,
    "manhattan": lambda x, y: np.stack([np.abs(x - row).sum(1) for row in y], axis=1),
    "chebyshev": lambda x, y: np.stack([np.abs(x - row).max(1) for row in y], axis=1),
    "cosine": lambda x, y: 1 - np.clip(_unit(x) @ _unit(y).T, -1, 1),
    "pearson": lambda x, y: (1 - _pearson(x, y)) / 2,
    "spearman": lambda x, y: (1 - _spearman(x, y)) / 2,
    "ys1": lambda x, y: 1 - _shape_similarity(_spearman(x, y), x, y),
    "yr1": lambda x, y: 1 - _shape_similarity(_pearson(x, y), x, y),
    "jackknife": lambda x, y: (1 - _jackknife(x, y)) / 2,
    "sharpened_cosine": lambda x, y: 1 - _sharpened_cosine(x, y),
}
METRICS["cityblock"] = METRICS["l1"] = METRICS["manhattan"]
METRICS["l2"] = METRICS["euclidean"]


def distances(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Matrix of distances from every row of ``x`` to every row of ``y``."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return METRICS[metric](np.asarray(x, float), np.asarray(y, float))


#: Distances that are a share of one less the inner product of shaped rows: (shape, share). Their totals need the sum of the shaped rows only.
PRODUCTS = {"cosine": (_unit, 1.0), "pearson": (_centred, 0.5), "spearman": (lambda x: _centred(_ranks(x)), 0.5)}
