"""Robust local regression (LOWESS) of two columns, on the driver for a few points and over a distributed table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Bins in which an order statistic is narrowed down, and values among which it is picked in the end.
BINS, FEW = 2048, 4096


def _near_share(n: int, span: float) -> int:
    return max(min(int(span * n + 1e-7), n), 2)


def _weights(distance: np.ndarray, reach: np.ndarray | float) -> np.ndarray:
    """Tricube weights of points inside ``reach``; 1 for the nearest thousandth, 0 for the farthest."""
    share = np.divide(distance, reach, out=np.where(distance > 0, 2.0, 0.0), where=np.asarray(reach) > 0)
    return np.where(share <= 0.001, 1.0, np.where(share <= 0.999, (1 - np.minimum(share, 1) ** 3) ** 3, 0.0))


def _value(w: np.ndarray, wu: np.ndarray, wuu: np.ndarray, wy: np.ndarray, wuy: np.ndarray, width: float) -> np.ndarray:
    """Height at the anchors of the weighted lines, from sums over u = x - anchor; the mean where the points are too close for a line. NaN without weight."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, height = wu / w, wy / w
        spread = wuu / w - mean ** 2
        slope = (wuy / w - mean * height) / spread
        return np.where(np.sqrt(np.maximum(spread, 0)) > 0.001 * width, height - slope * mean, height)


def _robust(residual: np.ndarray, scale: float) -> np.ndarray:
    share = np.abs(residual) / scale
    return np.where(share <= 0.001, 1.0, np.where(share <= 0.999, (1 - np.minimum(share, 1) ** 2) ** 2, 0.0))


def lowess(x: Sequence[float], y: Sequence[float], span: float = 2 / 3, iterations: int = 3, at: Sequence[float] | None = None) -> np.ndarray:
    """Fit at ``at`` (the points themselves if not given); residuals between the anchors are taken from straight lines."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    at = np.unique(x) if at is None else np.asarray(at, float)
    apart = np.abs(x[None, :] - at[:, None])
    reach = np.sort(apart, axis=1)[:, _near_share(len(x), span) - 1][:, None]
    robust = np.ones(len(x))
    for left in range(iterations, -1, -1):
        w, u = _weights(apart, reach) * robust, x[None, :] - at[:, None]
        fitted = _filled(at, _value(*[s.sum(1) for s in (w, w * u, w * u * u, w * y, w * u * y)], np.ptp(x)))
        residual = y - np.interp(x, at, fitted)
        scale = 6 * np.median(np.abs(residual))
        if not left or scale < 1e-7 * np.abs(residual).mean():
            break
        robust = _robust(residual, scale)
    return fitted


def _filled(at: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    """Anchors without weight lie on the line between their neighbours."""
    known = np.isfinite(fitted)
    return np.interp(at, at[known], fitted[known])


def _order_statistics(rows: DataFrame, values, count: int, ranks: np.ndarray) -> np.ndarray:
    """For each of ``count`` columns that ``values(batch)`` makes of a batch, (rows, count) and not negative, its ``ranks``-th smallest value (from 1).

    Each pass counts the values of all columns in bins of the stretch that must hold the wanted one, until few are left there; only counts, and at
    most ``FEW`` values a column, leave the tasks.
    """
    low, high, before = np.zeros(count), None, np.zeros(count, np.int64)

    def summed(run, schema: str) -> DataFrame:
        return rows.mapInPandas(run, schema)

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"c": np.arange(count), "v": values(pdf).max(axis=0)})
    high = np.zeros(count)
    for r in summed(tops, "c int, v double").groupBy("c").agg(F.max("v").alias("v")).collect():
        high[r["c"]] = r["v"]
    while True:
        edges = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, BINS + 1)[None, :]
        edges[:, -1] = high

        def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((count, BINS + 1), np.int64)
            for pdf in batches:
                v = values(pdf)
                for c in range(count):
                    inside = v[(v[:, c] >= low[c]) & (v[:, c] <= high[c]), c]
                    total[c] += np.bincount(np.searchsorted(edges[c], inside, side="left"), minlength=BINS + 1)[:BINS + 1]
            c, b = np.nonzero(total)
            yield pd.DataFrame({"c": c, "b": b, "n": total[c, b]})
        counts = np.zeros((count, BINS + 1), np.int64)
        for r in summed(bins, "c int, b int, n long").groupBy("c", "b").agg(F.sum("n").alias("n")).collect():
            counts[r["c"], r["b"]] = r["n"]
        upto = np.cumsum(counts, axis=1)
        bin_ = np.array([np.searchsorted(upto[c], ranks[c] - before[c]) for c in range(count)])
        here = counts[np.arange(count), bin_]
        # bin b holds what is above edge b - 1, up to edge b
        new_low = np.where(bin_ > 0, np.nextafter(edges[np.arange(count), np.maximum(bin_ - 1, 0)], np.inf), low)
        new_high = edges[np.arange(count), bin_]
        before = before + np.where(bin_ > 0, upto[np.arange(count), np.maximum(bin_ - 1, 0)], 0)
        low, high = new_low, new_high
        if ((here <= FEW // max(1, count // 8)) | (high <= low)).all():
            break

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = values(pdf)
            for c in range(count):
                if high[c] > low[c]:
                    yield pd.DataFrame({"c": c, "v": v[(v[:, c] >= low[c]) & (v[:, c] <= high[c]), c]})
    left: dict[int, list[float]] = {}
    for r in summed(few, "c int, v double").collect():
        left.setdefault(r["c"], []).append(r["v"])
    return np.array([sorted(left[c])[int(ranks[c] - before[c]) - 1] if c in left else high[c] for c in range(count)])


def lowess_trend(points: DataFrame, x: str, y: str, span: float = 0.5, iterations: int = 3, anchors: int = 101) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, fitted): robust local regression of a table at evenly spaced anchors over the range of ``x``.

    All anchors are fitted together: a task adds up, for each, the five sums of its weighted line over its own rows, so a pass returns a few
    hundred numbers whatever the size of the table. The reach of an anchor and the median residual are exact order statistics.
    """
    rows = checkpoint(points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(
        ~F.isnan("x") & ~F.isnan("y") & F.col("x").isNotNull() & F.col("y").isNotNull()))
    edge = rows.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")).first()
    if not edge["n"]:
        raise ValueError("a trend needs points")
    low, high, n = edge["low"], edge["high"], edge["n"]
    at = np.unique(np.linspace(low, high, anchors))
    reach = _order_statistics(rows, lambda pdf: np.abs(pdf["x"].to_numpy()[:, None] - at[None, :]), len(at), np.full(len(at), _near_share(n, span)))
    fitted, scale = None, None
    for left in range(iterations, -1, -1):
        now, now_scale = fitted, scale

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((5, len(at)))
            for pdf in batches:
                for start in range(0, len(pdf), 4096):
                    px, py = (pdf[c].to_numpy()[start:start + 4096] for c in ("x", "y"))
                    w = _weights(np.abs(px[None, :] - at[:, None]), reach[:, None])
                    if now is not None:
                        w = w * _robust(py - np.interp(px, at, now), now_scale)
                    u = px[None, :] - at[:, None]
                    total += np.stack([s.sum(1) for s in (w, w * u, w * u * u, w * py, w * u * py)])
            yield pd.DataFrame({"place": np.arange(total.size), "v": total.ravel()})
        added = np.zeros(5 * len(at))
        for r in rows.mapInPandas(sums, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():
            added[r["place"]] = r["v"]
        fitted = _filled(at, _value(*added.reshape(5, -1), high - low))
        if not left:
            break
        apart = lambda pdf, f=fitted: np.repeat(np.abs(pdf["y"].to_numpy() - np.interp(pdf["x"].to_numpy(), at, f))[:, None], 2, axis=1)
        middle = _order_statistics(rows, apart, 2, np.array([(n + 1) // 2, n // 2 + 1]))
        scale = 6 * float(middle.mean())
        if scale <= 0:
            break
    return at, fitted
