"""Column functions: log and scale transforms, ID extraction, name clean-up, labels."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint

# Identifier patterns of the public nomenclatures.
WBGENE_PATTERN = r"WBGene[0-9]{8}"
SEQUENCE_NAME_PATTERN = r"[A-Z,0-9]{5,8}\.[0-9]{1,2}"
GENE_NAME_PATTERN = r"[a-z]{3,4}-[A-Z,0-9.]{1,4}"
UNIPROT_PATTERN = r"([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})"
GO_PATTERN = r"(GO:[0-9]{7})"


def log_shift(column: str, base: float) -> Column:
    """log_base(x + 1)."""
    return F.log(float(base), F.col(column) + 1)


def transform_columns(df: DataFrame, columns: Sequence[str], function: str | Callable[[Column], Column]) -> DataFrame:
    """Apply ``log2``, ``log10``, ``logN``, ``ln``/``loge`` or a Column -> Column function."""
    if callable(function):
        return df.withColumns({c: function(F.col(c)) for c in columns})
    name = function.lower()
    if name in ("ln", "loge"):
        return df.withColumns({c: F.log1p(c) for c in columns})
    if name.startswith("log") and name[3:].isdigit():
        return df.withColumns({c: log_shift(c, int(name[3:])) for c in columns})
    raise ValueError(f"unknown transform {function!r}")


def map_elements(df: DataFrame, columns: Sequence[str], function: Callable[..., float], **kwargs) -> DataFrame:
    """Apply a Python function to every element. Prefer a Column function; this one leaves the JVM in Arrow batches."""
    @F.pandas_udf(T.DoubleType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: function(v, **kwargs), na_action="ignore").astype(float)
    return df.withColumns({c: run(F.col(c)) for c in columns})


def extract_ids(df: DataFrame, text: str, pattern: str, name: str = "id") -> DataFrame:
    """Distinct matches of ``pattern`` in a text column, over whole texts."""
    return df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).alias(name)
                     ).distinct()


def first_id(text: str | Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def sanitize_name(column: str | Column) -> Column:
    """Non-alphanumerics become ``_``; a leading digit is prefixed with ``var_``."""
    cleaned = F.regexp_replace(F.rtrim(column), r"[^\p{L}\p{N}]", "_")
    return F.when(cleaned.rlike(r"^[0-9]"), F.concat(F.lit("var_"), cleaned)).otherwise(cleaned)


def strip_suffixes(column: str | Column) -> Column:
    """File name without any of its suffixes (``a/b.fastq.gz`` -> ``a/b``)."""
    return F.regexp_replace(column, r"(?<=[^/])\.[^/]*$", "")


def strip_suffix(column: str | Column) -> Column:
    return F.regexp_replace(column, r"(?<=[^/])\.[^./]*$", "")


def remove_given_suffix(column: str | Column, suffixes: Sequence[str]) -> Column:
    """Remove the longest of the suffixes that the text ends with."""
    text = F.col(column) if isinstance(column, str) else column
    out = text
    for suffix in sorted(suffixes, key=len):
        out = F.when(text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(out)
    return out


def slug(column: str | Column) -> Column:
    cleaned = F.regexp_replace(column, r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(cleaned, r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


def pair_count(n: Column) -> Column:
    return n * (n - 1) / 2


def pvalue_stars(pvalue: str | Column, alpha: float = 0.05) -> Column:
    p = F.col(pvalue) if isinstance(pvalue, str) else pvalue
    return (F.when(p > alpha, "ns").when(p < 0.0001, "****").when(p < 0.001, "***")
            .when(p < 0.01, "**").otherwise("*"))


def shift_to_baseline(df: DataFrame, columns: Sequence[str], baseline: float = 0) -> DataFrame:
    """Subtract the smallest value of all ``columns`` so that the minimum becomes ``baseline``."""
    low = df.agg(F.least(*[F.min(c) for c in columns], F.lit(float("inf"))).alias("low")).first()["low"]
    return df.withColumns({c: F.col(c) - F.lit(low) + baseline for c in columns})


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-score per column with the population deviation; a constant column is only centred."""
    stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                   *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return df.withColumns({c: (F.col(c) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0)
                           for i, c in enumerate(columns)})


def _box_cox(x: Column, lam: float) -> Column:
    return F.ln(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def box_cox_lambdas(df: DataFrame, columns: Sequence[str], low: float = -5.0, high: float = 5.0, points: int = 33,
                    rounds: int = 6) -> dict[str, float]:
    """Maximum-likelihood lambda of ``x + 1`` per column.

    Repeated values are collapsed and stored once. Every round is then one aggregate that evaluates the likelihood
    of all columns on a grid and narrows the bracket around the best point; at the edge of a bracket it moves on instead.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("col"), (F.col(c).cast("double") + 1).alias("x")) for i, c in enumerate(columns)
    ]))).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    distinct = checkpoint(long.groupBy("col", "x").agg(F.count(F.lit(1)).alias("w")))
    base = {row["col"]: row for row in distinct.groupBy("col").agg(
        F.sum("w").alias("n"), (F.sum(F.col("w") * F.ln("x")) / F.sum("w")).alias("mean_log"),
        F.min("x").alias("low")).collect()}
    if any(row["low"] <= 0 for row in base.values()):
        raise ValueError("Box-Cox needs values greater than -1")
    brackets = {i: (low, high) for i in base}
    best: dict[int, float] = {}
    open_: set[int] = set()

    def per_column(values: dict[int, float]) -> Column:
        return F.element_at(F.create_map(*[F.lit(v) for i in values for v in (i, float(values[i]))]), F.col("col"))

    centre = per_column({i: row["mean_log"] for i, row in base.items()})
    logs = F.ln("x") - centre
    left = rounds
    while left or open_:
        left = left if open_ else left - 1
        step = {i: (b - a) / (points - 1) for i, (a, b) in brackets.items()}
        lam = per_column({i: a for i, (a, _) in brackets.items()}) + F.col("j") * per_column(step)
        grid = distinct.select("col", "x", "w", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("j"))
        # around the geometric mean the terms in lambda * mean(ln x) cancel, which leaves the variance to minimise
        flat = F.abs(lam) < 1e-12
        y = F.when(flat, logs).otherwise(F.expm1(lam * logs) / F.when(flat, 1.0).otherwise(lam))
        sums = grid.select("col", "j", "w", y.alias("y")).groupBy("col", "j").agg(
            F.sum(F.col("w") * F.col("y")).alias("s1"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("s2"))
        score: dict[int, dict[int, float]] = {i: {} for i in base}
        for row in sums.collect():
            i, n = row["col"], base[row["col"]]["n"]
            var = row["s2"] / n - (row["s1"] / n) ** 2
            score[i][row["j"]] = -math.log(var) if var > 0 else -math.inf
        for i, (a, b) in list(brackets.items()):
            top = max(score[i], key=score[i].__getitem__)
            best[i] = a + top * step[i]
            inner = score[i].get(1 if top == 0 else points - 2, -math.inf)
            if top in (0, points - 1) and score[i][top] > inner > -math.inf:  # the maximum lies outside: look there, as widely as before
                brackets[i] = (best[i] - (b - a), a + step[i]) if top == 0 else (b - step[i], best[i] + (b - a))
                open_.add(i)
            else:
                brackets[i] = (a + max(top - 1, 0) * step[i], a + min(top + 1, points - 1) * step[i])
                open_.discard(i)
    return {c: best[i] for i, c in enumerate(columns)}


def box_cox(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Box-Cox of ``x + 1`` with fitted lambda, then z-score, per column."""
    lambdas = box_cox_lambdas(df, columns)
    shaped = df.withColumns({c: _box_cox(F.col(c).cast("double") + 1, lambdas[c]) for c in columns})
    return standardize(shaped, columns)
