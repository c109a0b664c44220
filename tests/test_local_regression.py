"""Local regression against its definition, and what builds on it."""

import numpy as np
import pandas as pd
import pytest

from keyloom.operators import models
from keyloom.operators.local_regression import _order_statistics, lowess, lowess_trend


def brute_lowess(x, y, span, iterations, at):
    """One anchor at a time, by weighted least squares."""
    n, robust = len(x), np.ones(len(x))
    near = max(min(int(span * n + 1e-7), n), 2)
    for step in range(iterations + 1):
        fitted = []
        for a in at:
            d = np.abs(x - a)
            h = np.sort(d)[near - 1]
            w = np.where(d <= 0.001 * h, 1, np.where(d <= 0.999 * h, (1 - (d / h) ** 3) ** 3, 0)) * robust
            design = np.stack([np.ones(n), x - a], axis=1)
            fitted.append(np.linalg.lstsq(design * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0])
        residual = np.abs(y - np.interp(x, at, fitted))
        scale = 6 * np.median(residual)
        robust = np.where(residual <= 0.001 * scale, 1, np.where(residual <= 0.999 * scale, (1 - (residual / scale) ** 2) ** 2, 0))
    return np.array(fitted)


def noisy(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.gamma(2, 2, n)
    y = np.sin(x) + rng.normal(scale=0.2, size=n)
    y[:: 17] += 6  # outliers
    return x, y


def test_anchors_equal_brute_force(spark):
    x, y = noisy(700, 1)
    table = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(5)
    at, fitted = lowess_trend(table, "x", "y", 0.5, anchors=41)
    assert np.abs(fitted - brute_lowess(x, y, 0.5, 3, at)).max() < 1e-8
    assert np.abs(lowess(x, y, 0.5, at=at) - fitted).max() < 1e-8


def test_repeated_and_few_points(spark):
    same = spark.createDataFrame([(1.0, 2.0)] * 7, "x double, y double")
    assert [list(v) for v in lowess_trend(same, "x", "y")] == [[1.0], [2.0]]
    line = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(12)] + [(None, 1.0), (float("nan"), 1.0)], "x double, y double")
    at, fitted = lowess_trend(line, "x", "y")
    assert np.allclose(fitted, 3 * at + 1)
    with pytest.raises(ValueError):
        lowess_trend(line.limit(0), "x", "y")


def test_order_statistics_narrow_down(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.random(4000) * 1e-9, rng.random(6000), np.full(3000, 0.25)])
    table = spark.createDataFrame(pd.DataFrame({"v": v})).repartition(3)
    got = _order_statistics(table, lambda pdf: np.repeat(pdf["v"].to_numpy()[:, None], 4, axis=1), 4, np.array([1, 2000, 6500, 13_000]))
    assert list(got) == [np.sort(v)[i] for i in (0, 1999, 6499, 12_999)]


def brute_rejections(mean, p, cutoff, alpha):
    own = np.sort(p[(mean >= cutoff) & ~np.isnan(p)])
    below = np.flatnonzero(own < alpha * np.arange(1, len(own) + 1) / max(len(own), 1))
    return below[-1] + 1 if len(below) else 0


def test_rejections_of_all_cutoffs(spark):
    rng = np.random.default_rng(3)
    mean = rng.gamma(0.5, 200, 900)
    p = np.where((mean > 80) & (rng.random(900) < 0.4), rng.random(900) * 1e-3, rng.random(900))
    p[:20] = np.nan
    table = spark.createDataFrame([(float(m), None if np.isnan(q) else float(q)) for m, q in zip(mean, p)], "baseMean double, pvalue double")
    got = models.rejections(table, zeros=100)
    everything = np.concatenate([np.zeros(100), mean])
    assert np.allclose(got["share"], np.linspace(0.1, 0.95, 50))
    assert np.allclose(got["cutoff"], np.quantile(everything, got["share"]))
    assert list(got["rejected"]) == [brute_rejections(mean, p, c, 0.1) for c in got["cutoff"]]
    # rising to 100 at the 30th cut-off: the first within the usual distance of the curve's peak
    rising = np.concatenate([np.linspace(20, 100, 30), np.linspace(100, 60, 20)]).astype(int)
    table = pd.DataFrame({"share": got["share"], "cutoff": np.arange(50.0), "tests": 500, "rejected": rising})
    assert 24 <= models.filter_cutoff(table) <= 30
    assert models.filter_cutoff(table.assign(rejected=rising // 20)) == 0.0


def test_outliers_of_large_groups_are_replaced(spark):
    rng = np.random.default_rng(4)
    samples = [f"s{i}" for i in range(16)]
    counts = rng.negative_binomial(20, 20 / (20 + 200), size=(120, 16))
    counts[5, 3] = 60_000
    df = spark.createDataFrame(pd.DataFrame(counts, columns=samples).assign(gene=[f"g{i}" for i in range(120)]))
    design = pd.DataFrame({"sample": samples, "condition": ["a"] * 8 + ["b"] * 8})
    res = models.deseq2(df, "gene", samples, design, [("condition", "a", "b")])["condition_a_vs_b"].toPandas().set_index("gene")
    raw = models.deseq2(df, "gene", samples, design, [("condition", "a", "b")], cooks_cutoff=False)["condition_a_vs_b"].toPandas().set_index("gene")
    assert abs(res.loc["g5", "log2FoldChange"]) < 1 < abs(raw.loc["g5", "log2FoldChange"])
    assert res.loc["g5", "baseMean"] < 500 < raw.loc["g5", "baseMean"]
    others = [f"g{i}" for i in range(120) if i != 5]
    assert np.allclose(res.loc[others, "log2FoldChange"], raw.loc[others, "log2FoldChange"])
    assert not np.isnan(res.loc["g5", "pvalue"])
