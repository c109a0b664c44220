"""Differential expression: one small model per feature, solved inside the row's own task.

A feature's samples sit in one row, so fitting needs no shuffle; a batch of rows is solved with one set of numpy calls.
What features share (mean-variance trend, priors) comes from aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..session import checkpoint, spread
from . import designs
from .aggregates import column_sums
from .local_regression import lowess, lowess_trend
from .normalize import rle_factors
from .ranking import fdr_adjust, quantiles

ROWS_PER_TASK = 20_000


def _values(df: DataFrame, key: str, samples: Sequence[str], round_counts: bool = False) -> DataFrame:
    cells = [F.round(F.col(c)).cast("double") if round_counts else F.col(c).cast("double") for c in samples]
    return df.select(key, F.array(*cells).alias("y"))


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy())


def _map(rows: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield fn(pdf)
    return rows.mapInPandas(run, schema)


# --- linear models on log counts -------------------------------------------------------------------------------------------

def _weighted_fit(y: np.ndarray, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residual variance and (X'WX)^-1 for every row at once."""
    xtwx = np.einsum("sp,ns,sq->npq", x, w, x)
    inverse = np.linalg.inv(xtwx)
    beta = np.einsum("npq,qs,ns->np", inverse, x.T, w * y)
    resid = y - beta @ x.T
    df = x.shape[0] - x.shape[1]
    return beta, (w * resid ** 2).sum(1) / df, inverse


def _root_trend(rows: DataFrame, lib: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Local regression of the root of the residual deviation on the mean log count."""
    def first_pass(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.log2((_stack(pdf["y"]) + 0.5) / lib * 1e6)
        _, var, _ = _weighted_fit(y, np.ones_like(y), x)
        return pd.DataFrame({"ave": y.mean(1) + np.log2(lib).mean() - math.log2(1e6), "root": var ** 0.25})

    at, root = lowess_trend(_map(rows, first_pass, "ave double, root double").filter("root > 0"), "ave", "root", span=0.5)
    return at, np.maximum(root, 1e-8)


def voom_trend(df: DataFrame, key: str, samples: Sequence[str], table: pd.DataFrame, factors: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mean log count, root deviation) at the anchors of the trend behind the precision weights, for a checked design."""
    sizes = column_sums(df, samples)
    return _root_trend(checkpoint(_values(df, key, samples)), np.array([sizes[c] + 1 for c in samples]), designs.model_matrix(table, factors)[0])


def limma_voom(df: DataFrame, key: str, samples: Sequence[str], design: pd.DataFrame, comparisons: Sequence[tuple[str, str, str]] = (),
               covariates: Sequence[str] = (), lrt_factors: Sequence[str] = (), model_factors: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Precision-weighted linear models of log2 counts per million with moderated tests.

    ``comparisons`` are (factor, numerator, denominator). Returns one table per comparison, covariate and tested factor.
    """
    table = designs.check_design(design, samples)
    factors = list(model_factors or table.columns)
    x, names = designs.model_matrix(table, factors)
    n, p = x.shape
    if n <= p:
        raise ValueError("more samples than coefficients are needed")
    sizes = column_sums(df, samples)
    lib = np.array([sizes[c] + 1 for c in samples])
    rows = spread(checkpoint(_values(df, key, samples)), ROWS_PER_TASK)
    kind = df.schema[key].dataType.simpleString()

    def logcpm(y: np.ndarray) -> np.ndarray:
        return np.log2((y + 0.5) / lib * 1e6)

    at, root = _root_trend(rows, lib, x)

    def second_pass(pdf: pd.DataFrame) -> pd.DataFrame:
        y = logcpm(_stack(pdf["y"]))
        beta, _, _ = _weighted_fit(y, np.ones_like(y), x)
        fitted = beta @ x.T + np.log2(lib) - math.log2(1e6)
        w = np.interp(fitted, at, root) ** -4.0
        beta, var, inverse = _weighted_fit(y, w, x)
        return pd.DataFrame({key: pdf[key], "beta": list(beta), "var": var, "inv": list(inverse.reshape(len(y), -1)), "ave": y.mean(1)})

    fits = checkpoint(_map(rows, second_pass, f"{key} {kind}, beta array<double>, var double, inv array<double>, ave double"))
    df_resid = n - p
    prior = _variance_prior(fits, df_resid)

    def test(c: np.ndarray) -> DataFrame:
        """``c`` holds one contrast (t-test) or several rows (F-test)."""
        rank = len(c)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            beta, var = _stack(pdf["beta"]), pdf["var"].to_numpy()
            inverse = _stack(pdf["inv"]).reshape(len(var), p, p)
            d0, s0 = prior
            moderated = np.full(len(var), s0) if math.isinf(d0) else (d0 * s0 + df_resid * var) / (d0 + df_resid)
            total = d0 + df_resid
            est = beta @ c.T
            cov = np.einsum("ap,npq,bq->nab", c, inverse, c)
            if rank == 1:
                t = est[:, 0] / np.sqrt(cov[:, 0, 0] * moderated)
                pv = [stats.t_two_sided(v, total) for v in t]
                return pd.DataFrame({key: pdf[key], "logFC": est[:, 0], "AveExpr": pdf["ave"], "stat": t, "pvalue": pv})
            f = np.einsum("na,nab,nb->n", est, np.linalg.inv(cov), est) / rank / moderated
            pv = [stats.f_upper(v, rank, total) for v in f]
            return pd.DataFrame({key: pdf[key], "logFC": np.nan, "AveExpr": pdf["ave"], "stat": f, "pvalue": pv})

        tested = _map(fits, run, f"{key} {kind}, logFC double, AveExpr double, stat double, pvalue double")
        return fdr_adjust(checkpoint(tested), "pvalue").withColumn("logFC", F.nanvl("logFC", F.lit(None)))

    out = {}
    for factor, num, den in comparisons:
        out[f"{factor}_{num}_vs_{den}"] = test(designs.contrast(table, names, factor, num, den)[None, :])
    for cov in covariates:
        out[cov] = test(designs.covariate_contrast(names, cov)[None, :])
    for factor in lrt_factors:
        smaller = designs.model_matrix(table, designs.reduced_model(factors, factor))[1] if len(factors) > 1 else ["Intercept"]
        out[f"LRT_{factor}"] = test(np.eye(p)[[i for i, name in enumerate(names) if name not in smaller]])
    return out


def _variance_prior(fits: DataFrame, df_resid: int) -> tuple[float, float]:
    """Prior degrees of freedom and variance by moments of the log variances."""
    row = fits.filter("var > 0").agg(F.avg(F.ln("var")).alias("m"), F.var_samp(F.ln("var")).alias("v")).first()
    e = row["m"] - stats.digamma(df_resid / 2) + math.log(df_resid / 2)
    excess = (row["v"] or 0.0) - stats.trigamma(df_resid / 2)
    if excess <= 0:
        return math.inf, math.exp(e)
    d0 = 2 * stats.trigamma_inverse(excess)
    return d0, math.exp(e + stats.digamma(d0 / 2) - math.log(d0 / 2))


# --- negative binomial models ------------------------------------------------------------------------------------------------

def _nb_loglik(y: np.ndarray, mu: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Log-likelihood per row without the terms that do not depend on mu or alpha."""
    size = 1 / alpha[:, None]
    return (_lgamma(y + size) - _lgamma(size) - (y + size) * np.log1p(mu * alpha[:, None]) + y * np.log(mu * alpha[:, None])).sum(1)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Vectorised log gamma for positive x: recurrence up to 8, then Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(8):
        low = z < 8
        shift = np.where(low, shift - np.log(np.where(low, z, 1.0)), shift)
        z = np.where(low, z + 1, z)
    f = 1 / (z * z)
    return shift + (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f / 1680))) / z


def _nb_fit(y: np.ndarray, size: np.ndarray, alpha: np.ndarray, x: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Iteratively reweighted least squares of log means: (beta, mu, (X'WX)^-1); a tiny ridge keeps empty rows finite."""
    ridge = 1e-6 * np.eye(x.shape[1])
    target = np.log(y / size + 0.1)
    beta = target @ np.linalg.pinv(x).T
    for _ in range(rounds):
        mu = np.clip(size * np.exp(np.clip(beta @ x.T, -30, 30)), 0.5e-6, None)
        w = mu / (1 + alpha[:, None] * mu)
        z = np.log(mu / size) + (y - mu) / mu
        inverse = np.linalg.inv(np.einsum("sp,ns,sq->npq", x, w, x) + ridge)
        new = np.einsum("npq,qs,ns->np", inverse, x.T, w * z)
        change = np.abs(new - beta).max()
        beta = new
        if change < 1e-8:
            break
    mu = np.clip(size * np.exp(np.clip(beta @ x.T, -30, 30)), 0.5e-6, None)
    w = mu / (1 + alpha[:, None] * mu)
    return beta, mu, np.linalg.inv(np.einsum("sp,ns,sq->npq", x, w, x) + ridge)


def _dispersion(y: np.ndarray, mu: np.ndarray, x: np.ndarray, prior_log: np.ndarray | None = None, prior_var: float = math.inf,
                low: float = 1e-8, high: float = 10.0) -> np.ndarray:
    """Cox-Reid adjusted (and, with a prior, maximum a posteriori) dispersion per row by repeated grids on the log scale."""
    a, b = np.full(len(y), math.log(low)), np.full(len(y), math.log(high))
    points = 11
    best = a
    for _ in range(8):
        step = (b - a) / (points - 1)
        top, at = np.full(len(y), -np.inf), np.zeros(len(y))
        for j in range(points):
            la = a + j * step
            alpha = np.exp(la)
            w = mu / (1 + alpha[:, None] * mu)
            _, logdet = np.linalg.slogdet(np.einsum("sp,ns,sq->npq", x, w, x) + 1e-12 * np.eye(x.shape[1]))
            score = _nb_loglik(y, mu, alpha) - 0.5 * logdet
            if prior_log is not None and math.isfinite(prior_var):
                score = score - 0.5 * (la - prior_log) ** 2 / prior_var
            better = score > top
            top, best, at = np.where(better, score, top), np.where(better, la, best), np.where(better, j, at)
        a, b = a + np.maximum(at - 1, 0) * step, a + np.minimum(at + 1, points - 1) * step
    return np.exp(best)


def _dispersion_trend(genes: DataFrame) -> tuple[float, float]:
    """alpha(mean) = a1 / mean + a0, fitted to the genewise values by reweighted sums; outliers leave after the first round."""
    a0, a1 = 0.1, 1.0
    for _ in range(10):
        fit = F.lit(a0) + F.lit(a1) / F.col("mean")
        ratio = F.col("disp") / fit
        u, w = 1 / F.col("mean"), 1 / (fit * fit)
        row = genes.filter("disp > 1e-7 and mean > 0").filter((ratio > 1e-4) & (ratio < 15)).agg(
            F.sum(w).alias("w"), F.sum(w * u).alias("wu"), F.sum(w * u * u).alias("wuu"),
            F.sum(w * F.col("disp")).alias("wy"), F.sum(w * u * F.col("disp")).alias("wuy")).first()
        if row["w"] is None:
            break
        det = row["w"] * row["wuu"] - row["wu"] ** 2
        if det <= 0:
            a0, a1 = max(row["wy"] / row["w"], 1e-8), 0.0
            break
        new0 = max((row["wuu"] * row["wy"] - row["wu"] * row["wuy"]) / det, 1e-8)
        new1 = max((row["w"] * row["wuy"] - row["wu"] * row["wy"]) / det, 0.0)
        done = abs(new0 - a0) + abs(new1 - a1) < 1e-6
        a0, a1 = new0, new1
        if done:
            break
    return a0, a1


def _genewise_dispersion(y: np.ndarray, size: np.ndarray, x: np.ndarray) -> np.ndarray:
    base = y / size
    mean, var = base.mean(1), base.var(1, ddof=1)
    rough = np.clip((var - mean * (1 / size).mean()) / mean ** 2, 1e-8, 10)
    _, mu, _ = _nb_fit(y, size, rough, x)
    disp = _dispersion(y, mu, x)
    _, mu, _ = _nb_fit(y, size, disp, x)
    return _dispersion(y, mu, x)


def _robust_dispersion(base: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Dispersion by moments that an outlying count cannot move: trimmed squared deviations from trimmed means of the conditions with three samples or more
    (the largest of them), of all samples where there are none. The factors make trimmed squares of normal values unbiased."""
    cells = [own for own in {tuple(r): np.flatnonzero((x == r).all(axis=1)) for r in x}.values() if len(own) >= 3]
    found = []
    for own in cells or [np.arange(x.shape[0])]:
        trim, factor = (1 / 8, 1.51) if not cells or len(own) >= 24 else (1 / 4, 1.86) if len(own) > 3 else (1 / 3, 2.04)
        part = base[:, own]
        found.append(factor * _trimmed_mean((part - _trimmed_mean(part, trim)[:, None]) ** 2, trim))
    mean = base.mean(1)
    return np.maximum((np.max(found, axis=0) - mean) / np.maximum(mean, 1e-12) ** 2, 0.04)


def _trimmed_mean(values: np.ndarray, trim: float = 0.2) -> np.ndarray:
    """Mean of each row without the lowest and highest share ``trim`` of it."""
    cut = int(values.shape[1] * trim)
    return np.sort(values, axis=1)[:, cut:values.shape[1] - cut].mean(1)


#: Cut-offs that independent filtering compares.
CUTOFFS = 50


def rejections(tested: DataFrame, zeros: int = 0, alpha: float = 0.1, mean: str = "baseMean", pvalue: str = "pvalue") -> pd.DataFrame:
    """(share, cutoff, tests, rejected): of the rows whose mean reaches each of ``CUTOFFS`` quantiles, those with a p-value and those that
    Benjamini-Hochberg rejects at ``alpha``. ``zeros`` rows of mean 0 without a p-value count in the quantiles.

    The rejections of all cut-offs are counted together: from all tests down, a limit gives a number of p-values below it, which gives the
    next limit, until none of the numbers moves. Those are the step-up rejections, without sorting for each cut-off."""
    n = tested.count()
    low = (zeros + tested.filter(F.col(mean) == 0).count()) / max(n + zeros, 1)
    share = np.linspace(low, 0.95 if low < 0.95 else 1.0, CUTOFFS)
    places = np.maximum((n + zeros - 1) * share - zeros, 0)  # quantiles of all rows, as places among those of the table
    found = quantiles(tested, mean, {f"q{i}": min(1.0, v / max(n - 1, 1)) for i, v in enumerate(places)}).first()
    inside = (n + zeros - 1) * share - zeros
    smallest = tested.agg(F.min(mean)).first()[0] or 0.0
    cutoff = np.array([found[f"q{i}"] if inside[i] >= 0 else max(0.0, smallest * (1 + inside[i])) for i in range(CUTOFFS)]) if found else np.zeros(CUTOFFS)
    known = checkpoint(tested.filter(F.col(pvalue).isNotNull()).select(F.col(mean).alias("m"), F.col(pvalue).alias("p")))
    counted = lambda conditions: np.array(known.agg(*[F.count(F.when(c, 1)) for c in conditions]).first(), dtype=float)
    tests = counted([F.col("m") >= float(c) for c in cutoff])
    rejected = tests.copy()
    while True:
        limits = alpha * rejected / np.maximum(tests, 1)
        fewer = counted([(F.col("m") >= float(c)) & (F.col("p") < float(t)) for c, t in zip(cutoff, limits)])
        if (fewer == rejected).all():
            break
        rejected = fewer
    return pd.DataFrame({"share": share, "cutoff": cutoff, "tests": tests.astype(int), "rejected": rejected.astype(int)})


def filter_cutoff(counted: pd.DataFrame) -> float:
    """The lowest cut-off that rejects nearly as many as the best of a curve through all: no less than its peak minus the usual distance to the curve."""
    number = counted["rejected"].to_numpy(float)
    if number.max() <= 10:
        return float(counted["cutoff"].iloc[0])
    curve = np.interp(counted["share"], np.unique(counted["share"]), lowess(counted["share"], number, 0.2))
    some = number > 0
    enough = np.flatnonzero(number > curve.max() - math.sqrt(((number - curve)[some] ** 2).mean()))
    return float(counted["cutoff"].iloc[enough[0] if len(enough) else 0])


def deseq2(df: DataFrame, key: str, samples: Sequence[str], design: pd.DataFrame, comparisons: Sequence[tuple[str, str, str]] = (),
           covariates: Sequence[str] = (), lrt_factors: Sequence[str] = (), model_factors: Sequence[str] | None = None,
           scaling_factors: dict[str, float] | None = None, cooks_cutoff: bool = True, independent_filtering: bool = True,
           filter_alpha: float = 0.1) -> dict[str, DataFrame]:
    """Negative binomial models with shrunken dispersions: Wald tests per contrast, likelihood-ratio tests per factor.

    Counts are rounded first. Outlying counts (Cook's distance) of conditions with seven or more samples are replaced by the trimmed mean of the row,
    and the row is fitted again; rows with one in conditions of three to six get no p-value. Adjusted p-values come from the rows whose mean is
    above the cut-off with the most rejections at ``filter_alpha`` (``independent_filtering``); rows below it have none.
    """
    table = designs.check_design(design, samples)
    factors = list(model_factors or table.columns)
    x, names = designs.model_matrix(table, factors)
    n, p = x.shape
    if n <= p:
        raise ValueError("more samples than coefficients are needed")
    factors_by_sample = scaling_factors or rle_factors(df, samples)
    size = np.array([factors_by_sample[c] for c in samples])
    rows = spread(checkpoint(_values(df, key, samples, round_counts=True).filter(F.exists("y", lambda v: v > 0))), ROWS_PER_TASK)
    kind = df.schema[key].dataType.simpleString()

    def genewise(pdf: pd.DataFrame) -> pd.DataFrame:
        y = _stack(pdf["y"])
        return pd.DataFrame({key: pdf[key], "y": list(y), "mean": (y / size).mean(1), "disp": _genewise_dispersion(y, size, x)})

    genes = checkpoint(_map(rows, genewise, f"{key} {kind}, y array<double>, mean double, disp double"))
    a0, a1 = _dispersion_trend(genes)
    resid = genes.filter("disp > 1e-6").select((F.ln("disp") - F.ln(F.lit(a0) + F.lit(a1) / F.col("mean"))).alias("r"))
    middle = quantiles(resid, "r", {"q": 0.5}).first()
    middle = middle["q"] if middle and middle["q"] is not None else 0.0
    mad = quantiles(resid.select(F.abs(F.col("r") - F.lit(middle)).alias("a")), "a", {"q": 0.5}).first()
    noise = ((mad["q"] if mad and mad["q"] is not None else 1.0) * 1.4826) ** 2
    prior_var = max(noise - stats.trigamma((n - p) / 2), 0.25)

    cell = np.array([sum(tuple(a) == tuple(b) for b in x) for a in x])  # samples with the same condition
    limit = _f_quantile(0.99, p, n - p) if cooks_cutoff else math.inf

    def shrunken(y: np.ndarray, mean: np.ndarray, own: np.ndarray) -> tuple:
        center = np.log(a0 + a1 / mean)
        _, mu, _ = _nb_fit(y, size, own, x)
        disp = _dispersion(y, mu, x, center, prior_var)
        # values far above the trend are kept as they are
        disp = np.where(np.log(own) > center + 2 * math.sqrt(noise), own, disp)
        beta, mu, inverse = _nb_fit(y, size, disp, x)
        w = mu / (1 + disp[:, None] * mu)
        hat = w * np.einsum("sp,npq,sq->ns", x, inverse, x)
        pearson = (y - mu) ** 2 / (mu + _robust_dispersion(y / size, x)[:, None] * mu ** 2)
        return disp, beta, inverse, mu, pearson / p * hat / (1 - np.clip(hat, 0, 0.999)) ** 2

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        y, mean = _stack(pdf["y"]), pdf["mean"].to_numpy()
        disp, beta, inverse, mu, cooks = shrunken(y, mean, pdf["disp"].to_numpy())
        out = (cooks > limit) & (cell >= 7)
        again = np.flatnonzero(out.any(axis=1))
        if len(again):
            y = y.copy()
            y[again] = np.where(out[again], np.trunc(_trimmed_mean(y[again] / size)[:, None] * size), y[again])
            fitted = again[(y[again] > 0).any(axis=1)]
            mean = (y / size).mean(1)
            parts = shrunken(y[fitted], mean[fitted], _genewise_dispersion(y[fitted], size, x)) if len(fitted) else None
            if parts:
                disp[fitted], beta[fitted], inverse[fitted], mu[fitted] = parts[:4]
        counted = np.where((cell >= 3) & (cell < 7), cooks, 0.0).max(axis=1)
        return pd.DataFrame({key: pdf[key], "y": list(y), "baseMean": mean, "alpha": disp, "beta": list(beta),
                             "inv": list(inverse.reshape(len(y), -1)), "loglik": _nb_loglik(y, mu, disp), "cooks": counted})

    fits = checkpoint(_map(genes, final, f"{key} {kind}, y array<double>, baseMean double, alpha double, beta array<double>, "
                                         "inv array<double>, loglik double, cooks double"))
    zeros = df.count() - rows.count() if independent_filtering else 0
    schema = f"{key} {kind}, baseMean double, log2FoldChange double, lfcSE double, stat double, pvalue double"

    def shaped(pdf: pd.DataFrame, lfc, se, stat, pv) -> pd.DataFrame:
        pv = np.where(pdf["cooks"].to_numpy() > limit, np.nan, np.asarray(pv, float))
        return pd.DataFrame({key: pdf[key], "baseMean": pdf["baseMean"], "log2FoldChange": lfc, "lfcSE": se, "stat": stat, "pvalue": pv})

    def finish(tested: DataFrame) -> DataFrame:
        known = checkpoint(tested.withColumn("pvalue", F.nanvl("pvalue", F.lit(None))))
        if not independent_filtering:
            return fdr_adjust(known, "pvalue")
        least = filter_cutoff(rejections(known, zeros, filter_alpha))
        return fdr_adjust(known.withColumn("__p", F.when(F.col("baseMean") >= least, F.col("pvalue"))), "__p").drop("__p")

    def wald(c: np.ndarray) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            beta = _stack(pdf["beta"])
            inverse = _stack(pdf["inv"]).reshape(len(beta), p, p)
            est, se = beta @ c, np.sqrt(np.einsum("p,npq,q->n", c, inverse, c))
            z = est / se
            return shaped(pdf, est / math.log(2), se / math.log(2), z, [stats.normal_two_sided(v) for v in z])
        return finish(_map(fits, run, schema))

    def likelihood_ratio(smaller: np.ndarray) -> DataFrame:
        rank = p - smaller.shape[1]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            y, alpha, beta = _stack(pdf["y"]), pdf["alpha"].to_numpy(), _stack(pdf["beta"])
            _, mu, _ = _nb_fit(y, size, alpha, smaller)
            stat = np.maximum(2 * (pdf["loglik"].to_numpy() - _nb_loglik(y, mu, alpha)), 0)
            inverse = _stack(pdf["inv"]).reshape(len(beta), p, p)
            return shaped(pdf, beta[:, -1] / math.log(2), np.sqrt(inverse[:, -1, -1]) / math.log(2), stat,
                          [stats.chi2_upper(v, rank) for v in stat])
        return finish(_map(fits, run, schema))

    out = {}
    for factor, num, den in comparisons:
        out[f"{factor}_{num}_vs_{den}"] = wald(designs.contrast(table, names, factor, num, den))
    for cov in covariates:
        out[cov] = wald(designs.covariate_contrast(names, cov))
    for factor in lrt_factors:
        rest = designs.reduced_model(factors, factor)
        smaller = designs.model_matrix(table, rest)[0] if rest else np.ones((n, 1))
        out[f"LRT_{factor}"] = likelihood_ratio(smaller)
    return out


def _f_quantile(prob: float, d1: float, d2: float) -> float:
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - stats.f_upper(mid, d1, d2) < prob else (lo, mid)
    return hi


def simplified_design(samples_by_condition: dict[str, Sequence[str]]) -> pd.DataFrame:
    """A one-factor design from condition -> samples."""
    return pd.DataFrame([(s, c) for c, group in samples_by_condition.items() for s in group], columns=["sample", "condition"])
