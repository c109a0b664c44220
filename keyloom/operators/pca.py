"""Principal components with samples as observations and features as variables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..session import checkpoint


def row_box_cox(values: np.ndarray, low: float = -5.0, high: float = 5.0, points: int = 33, rounds: int = 6) -> np.ndarray:
    """Box-Cox of x + 1 with lambda fitted per row; vectorised over the rows of one batch."""
    x = values + 1.0
    if (x <= 0).any():
        raise ValueError("Box-Cox needs values greater than -1")
    logs = np.log(x)
    mean_log = logs.mean(1)
    a, b = np.full(len(x), low), np.full(len(x), high)
    centred = logs - mean_log[:, None]
    best = a
    for _ in range(rounds):
        step = (b - a) / (points - 1)
        top = np.full(len(x), -np.inf)
        best, at = a.copy(), np.zeros(len(x))
        for j in range(points):
            lam = a + j * step
            # variance of x^lambda / lambda, computed around the geometric mean to stay in range
            y = np.where(np.abs(lam)[:, None] < 1e-12, centred,
                         np.expm1(lam[:, None] * centred) / np.where(np.abs(lam) < 1e-12, 1, lam)[:, None])
            var = y.var(1)
            with np.errstate(divide="ignore"):
                # the scale exp(lambda * mean_log) of y cancels against (lambda - 1) * mean_log up to a constant
                score = -0.5 * np.log(var) - mean_log
            better = score > top
            top, best, at = np.where(better, score, top), np.where(better, lam, best), np.where(better, j, at)
        a, b = a + np.maximum(at - 1, 0) * step, a + np.minimum(at + 1, points - 1) * step
    lam = best[:, None]
    return np.where(np.abs(lam) < 1e-12, logs, np.expm1(lam * logs) / np.where(np.abs(lam) < 1e-12, 1, lam))


def standardized_rows(df: DataFrame, key: str, samples: Sequence[str], power_transform: bool = True) -> DataFrame:
    """(key, z): each feature standardised over the samples, after a per-feature Box-Cox when asked."""
    values = F.array(*[F.col(c).cast("double") for c in samples])
    if not power_transform:
        row = df.select(key, values.alias("v"))
        m, s = arrays.mean(F.col("v")), arrays.std_pop(F.col("v"))
        return row.select(key, F.transform("v", lambda x: (x - m) / F.when(s > 0, s).otherwise(1.0)).alias("z"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                y = row_box_cox(np.stack(pdf["v"].to_numpy()))
                sd = y.std(1, keepdims=True)
                flat = sd <= 1e-12 * np.maximum(1, np.abs(y).max(1, keepdims=True))
                z = np.where(flat, 0.0, (y - y.mean(1, keepdims=True)) / np.where(flat, 1, sd))
                yield pd.DataFrame({key: pdf[key], "z": list(z)})

    return df.select(key, values.alias("v")).mapInPandas(run, f"{key} {kind}, z array<double>")


def gram_matrix(rows: DataFrame, n: int) -> np.ndarray:
    """Sum over features of z_i * z_j: a samples x samples matrix from one product per batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for pdf in batches:
            if len(pdf):
                z = np.stack(pdf["z"].to_numpy())
                total += z.T @ z
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "g": total[i, j]})

    gram = np.zeros((n, n))
    for r in rows.select("z").mapInPandas(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        gram[r["i"], r["j"]] = r["g"]
    return gram


class PCA:
    """Fitted components. ``scores`` and ``explained`` are sample-sized; loadings are computed row by row."""

    def __init__(self, df: DataFrame, key: str, samples: Sequence[str], power_transform: bool = True):
        self.key, self.samples = key, list(samples)
        self.rows = checkpoint(standardized_rows(df, key, samples, power_transform))
        gram = gram_matrix(self.rows, len(self.samples))
        # features are centred over the samples already, so the Gram matrix is that of the centred data
        values, vectors = np.linalg.eigh(gram)
        order = np.argsort(values)[::-1]
        values, vectors = np.clip(values[order], 0, None), vectors[:, order]
        signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        self._u, self._s = vectors * np.where(signs == 0, 1, signs), np.sqrt(values)

    def scores(self, n_components: int = 3) -> DataFrame:
        table = self._u * self._s
        names = [f"PC{i + 1}" for i in range(min(n_components, len(self.samples)))]
        rows = [(c, *map(float, table[i, :len(names)])) for i, c in enumerate(self.samples)]
        return self.rows.sparkSession.createDataFrame(rows, "sample string, " + ", ".join(f"{n} double" for n in names))

    def explained(self) -> DataFrame:
        """(component, percent, cumulative)."""
        total = float((self._s ** 2).sum()) or 1.0
        share = self._s ** 2 / total * 100
        return self.rows.sparkSession.createDataFrame(
            [(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(share, np.cumsum(share)))],
            "component int, percent double, cumulative double")

    def loadings(self, components: Sequence[int] = (1, 2, 3)) -> DataFrame:
        """(key, PC1, ...): weight of each feature in the components."""
        def weight(c: int):
            s = self._s[c - 1]
            v = self._u[:, c - 1] / s if s > 0 else np.zeros(len(self.samples))
            return arrays.total(F.zip_with("z", F.array(*[F.lit(float(x)) for x in v]), lambda a, b: a * b)).alias(f"PC{c}")
        return self.rows.select(self.key, *[weight(c) for c in components])


def sort_by_principal_component(df: DataFrame, key: str, samples: Sequence[str], component: int = 1,
                                ascending: bool = True, power_transform: bool = True) -> DataFrame:
    loadings = PCA(df, key, samples, power_transform).loadings([component])
    name = f"PC{component}"
    order = F.asc(name) if ascending else F.desc(name)
    return df.join(loadings, key).orderBy(order, key).select(*df.columns)


def split_by_principal_components(df: DataFrame, key: str, samples: Sequence[str], components: Sequence[int] = (1,),
                                  gene_fraction: float = 0.1, power_transform: bool = True) -> DataFrame:
    """Rows with the extreme loadings, tagged with ``component`` and ``side`` (top or bottom)."""
    n = int(gene_fraction * df.count() * 0.5)
    loadings = checkpoint(PCA(df, key, samples, power_transform).loadings(components))
    picks = None
    for c in components:
        for side, order in (("top", F.desc(f"PC{c}")), ("bottom", F.asc(f"PC{c}"))):
            part = loadings.orderBy(order, key).limit(n).select(key, F.lit(c).alias("component"), F.lit(side).alias("side"))
            picks = part if picks is None else picks.unionByName(part)
    return df.join(picks, key)
