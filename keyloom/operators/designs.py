"""Design matrices: validation, model coefficients and contrasts. Everything here is sample-sized."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd

RESERVED = {"intercept", "condition_", "sample"}


def check_design(design: pd.DataFrame, samples: Sequence[str]) -> pd.DataFrame:
    """A design indexed by sample (first column), in the order of the count columns. Names must match exactly, be unique
    and be usable in a model formula."""
    names = design.iloc[:, 0].astype(str).tolist()
    if len(set(names)) != len(names):
        raise ValueError("sample names in the design matrix repeat")
    if set(names) != set(samples):
        raise ValueError(f"sample names do not match the table: {sorted(set(names) ^ set(samples))}")
    factors = list(design.columns[1:])
    if len(set(factors)) != len(factors):
        raise ValueError("factor names in the design matrix repeat")
    bad = [f for f in factors if not re.fullmatch(r"[A-Za-z.][A-Za-z0-9._]*", f) or f.lower() in RESERVED]
    if bad:
        raise ValueError(f"invalid factor names: {bad}")
    out = design.copy()
    out.iloc[:, 0] = names
    return out.set_index(design.columns[0]).loc[list(samples)]


def formula(factors: Sequence[str]) -> str:
    return "~ " + " + ".join(factors)


def _is_numeric(values: pd.Series) -> bool:
    return pd.api.types.is_numeric_dtype(values) and not pd.api.types.is_bool_dtype(values)


def _poly(x: np.ndarray, degree: int) -> np.ndarray:
    """Orthonormal polynomial columns 1..degree."""
    powers = np.vander(x - x.mean(), degree + 1, increasing=True)
    q, r = np.linalg.qr(powers)
    q = q * np.sign(np.diag(r))
    return q[:, 1:]


def _term_columns(design: pd.DataFrame, term: str, baselines: Mapping[str, str]) -> dict[str, np.ndarray]:
    if ":" in term:
        left, right = term.split(":", 1)
        return {f"{a}:{b}": x * y for a, x in _term_columns(design, left, baselines).items()
                for b, y in _term_columns(design, right, baselines).items()}
    poly = re.fullmatch(r"poly\(\s*(\w[\w.]*)\s*,\s*(?:degree\s*=\s*)?(\d+)\s*\)", term)
    if poly:
        name, degree = poly.group(1), int(poly.group(2))
        columns = _poly(design[name].to_numpy(float), degree)
        return {f"poly({name}, {degree}){i + 1}": columns[:, i] for i in range(degree)}
    if term not in design.columns:
        raise ValueError(f"unknown factor {term!r}")
    values = design[term]
    if _is_numeric(values):
        return {term: values.to_numpy(float)}
    levels = sorted(values.astype(str).unique())
    base = baselines.get(term, levels[0])
    return {f"{term}{level}": (values.astype(str) == level).to_numpy(float) for level in levels if level != base}


def model_matrix(design: pd.DataFrame, factors: Sequence[str] | None = None,
                 baselines: Mapping[str, str] | None = None) -> tuple[np.ndarray, list[str]]:
    """Columns and coefficient names of main effects, covariates, ``a:b`` interactions and ``poly(x, degree=n)``."""
    terms = list(factors or design.columns)
    columns: dict[str, np.ndarray] = {"Intercept": np.ones(len(design))}
    for term in terms:
        columns.update(_term_columns(design, term.replace(" ", "") if ":" in term else term, baselines or {}))
    x = np.column_stack(list(columns.values()))
    if np.linalg.matrix_rank(x) < x.shape[1]:
        raise ValueError("the design matrix is not of full rank")
    return x, list(columns)


def reduced_model(factors: Sequence[str], drop: str) -> list[str]:
    """The factors of the likelihood-ratio test's smaller model."""
    if drop not in factors:
        raise ValueError(f"{drop!r} is not a factor of the model")
    return [f for f in factors if f != drop and drop not in f.split(":")]


def contrast(design: pd.DataFrame, names: Sequence[str], factor: str, numerator: str, denominator: str) -> np.ndarray:
    """Coefficient weights of ``numerator`` against ``denominator`` levels of a factor."""
    levels = set(design[factor].astype(str))
    if {numerator, denominator} - levels:
        raise ValueError(f"unknown levels of {factor}: {sorted({numerator, denominator} - levels)}")
    c = np.zeros(len(names))
    for level, sign in ((numerator, 1.0), (denominator, -1.0)):
        if f"{factor}{level}" in names:
            c[list(names).index(f"{factor}{level}")] += sign
    return c


def covariate_contrast(names: Sequence[str], covariate: str) -> np.ndarray:
    if covariate not in names:
        raise ValueError(f"unknown covariate {covariate!r}")
    return np.array([float(n == covariate) for n in names])


def design_table(spark, design: pd.DataFrame, x: np.ndarray, names: Sequence[str]):
    """The model matrix as a (sample, coefficient, value) DataFrame."""
    rows = [(str(s), n, float(x[i, j])) for i, s in enumerate(design.index) for j, n in enumerate(names)]
    return spark.createDataFrame(rows, "sample string, coefficient string, value double")
