"""Summaries of feature tables: describe, histograms, group averages, spreads, correlations, biotype counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays
from .filters import numeric_columns, require_columns
from .ranking import average_ranks, quantiles

MISSING_BIOTYPE = "_missing_from_biotype_reference"


def to_long(df: DataFrame, key: str | Sequence[str], columns: Sequence[str], name: str = "sample",
            value: str = "value") -> DataFrame:
    """Wide to long: one row per key and column. Row-local, no shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keys, F.inline(pairs))


def to_wide(df: DataFrame, key: str, columns: Sequence[str], name: str = "sample", value: str = "value") -> DataFrame:
    return df.groupBy(key).pivot(name, list(columns)).agg(F.first(value))


def describe(df: DataFrame, percentiles: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """One row per column: count, null_count, mean, std, min, max and nearest-rank percentiles of numeric columns;
    text columns get the counts only in ``text_min``/``text_max``."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    other = [c for c in df.columns if c not in numeric]
    long = to_long(df, [], numeric, "column", "x")
    stats = long.groupBy("column").agg(
        F.count("x").alias("count"), F.sum(F.col("x").isNull().cast("long")).alias("null_count"),
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    names = {f"{p * 100:g}%": p for p in percentiles}
    if numeric:
        q = quantiles(long, "x", names, ["column"], "nearest")
        stats = stats.join(q, "column", "left")
    if not other:
        return stats
    text = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("s")) for c in other]))).groupBy("column").agg(
        F.count("s").alias("count"), F.sum(F.col("s").isNull().cast("long")).alias("null_count"),
        F.min("s").alias("text_min"), F.max("s").alias("text_max"))
    return stats.unionByName(text, allowMissingColumns=True)


# --- biotypes ----------------------------------------------------------------------------------------------

def biotypes(df: DataFrame, key: str, reference: DataFrame, ref_key: str, biotype: str) -> DataFrame:
    """Distinct keys per biotype, with a bucket for keys the reference does not know."""
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    ref = reference.select(F.col(ref_key).alias(key), F.col(biotype).alias("biotype"))
    return (keys.join(ref, key, "left").groupBy(F.coalesce("biotype", F.lit(MISSING_BIOTYPE)).alias("biotype"))
            .agg(F.count(F.lit(1)).alias("count")))


def biotypes_long(df: DataFrame, key: str, reference: DataFrame, ref_key: str, biotype: str,
                  columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of every data column per biotype (columns ``col_stat``)."""
    columns = list(columns or numeric_columns(df, [key]))
    ref = reference.select(F.col(ref_key).alias(key), F.col(biotype).alias("biotype"))
    tagged = df.join(ref, key, "left").withColumn("biotype", F.coalesce("biotype", F.lit(MISSING_BIOTYPE)))
    long = to_long(tagged, "biotype", columns, "column", "x")
    stats = long.groupBy("biotype", "column").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    q = quantiles(long, "x", {"25%": 0.25, "50%": 0.5, "75%": 0.75}, ["biotype", "column"])
    full = stats.join(q, ["biotype", "column"])
    order = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    return full.groupBy("biotype").pivot("column", columns).agg(*[F.first(s).alias(s) for s in order])


# --- sample groups -------------------------------------------------------------------------------------------

def group_names(groups: Sequence[Sequence[str]]) -> list[str]:
    return [";".join(g) for g in groups]


def triplicates(columns: Sequence[str]) -> list[list[str]]:
    ordered = sorted(columns)
    return [ordered[i:i + 3] for i in range(0, len(ordered), 3)]


def average_replicates(df: DataFrame, key: str, groups: Sequence[Sequence[str]], names: Sequence[str] | None = None,
                       function: str = "mean") -> DataFrame:
    """Row-wise mean, median or geometric mean of each group of columns."""
    if function not in arrays.AVERAGES:
        raise ValueError(f"function must be one of {sorted(arrays.AVERAGES)}")
    for g in groups:
        require_columns(df, g)
    names = names or group_names(groups)
    average = arrays.AVERAGES[function]
    return df.select(key, *[average(arrays.values(g)).alias(n) for n, g in zip(names, groups, strict=True)])


def fold_change(df: DataFrame, key: str, numerator: Sequence[str], denominator: Sequence[str],
                name: str = "Fold Change") -> DataFrame:
    """(mean(numerator) + 1) / (mean(denominator) + 1)."""
    ratio = (arrays.mean(arrays.values(numerator)) + 1) / (arrays.mean(arrays.values(denominator)) + 1)
    return df.select(key, ratio.alias(name))


def group_centre_spread(df: DataFrame, key: str, groups: Mapping[str, Sequence[str]], average: str = "mean",
                        spread: str = "sem") -> DataFrame:
    """(key, group, centre, below, above): centre and error-bar lengths of each sample group, row by row."""
    return df.select(key, F.inline(F.array(*[
        F.struct(F.lit(name).alias("group"), *_centre_spread(columns, average, spread))
        for name, columns in groups.items()])))


def _centre_spread(columns: Sequence[str], average: str, spread: str) -> list[Column]:
    arr = arrays.values(columns)
    centre = arrays.AVERAGES[average](arr)
    root_n = F.sqrt(F.size(arr).cast("double"))
    if len(columns) == 1 and spread != "iqr":
        below = above = F.lit(0.0)
    elif spread == "sem":
        below = above = arrays.std(arr) / root_n
    elif spread == "std":
        below = above = arrays.std(arr)
    elif spread in ("gstd", "gsem"):
        deviation = arrays.std(arrays.log_values(arr))
        factor = F.exp(deviation / root_n if spread == "gsem" else deviation)
        below, above = centre - centre / factor, centre * factor - centre
    elif spread == "iqr":
        below = above = arrays.quantile(arr, 0.75, "nearest") - arrays.quantile(arr, 0.25, "nearest")
    elif spread == "range":
        below, above = centre - F.array_min(arr), F.array_max(arr) - centre
    else:
        raise ValueError(f"unknown spread {spread!r}")
    return [centre.alias("centre"), below.alias("below"), above.alias("above")]


def distribution_summary(df: DataFrame, columns: Sequence[str],
                         groups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Five-number summary of log10(x + 1) per sample, or per group of samples averaged first."""
    if groups:
        df = df.select(*[arrays.mean(arrays.values(g)).alias(n) for n, g in groups.items()])
        columns = list(groups)
    long = to_long(df, [], columns).select("sample", F.log10(F.col("value") + 1).alias("y"))
    counts = long.groupBy("sample").agg(F.count("y").alias("count"))
    probs = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return counts.join(quantiles(long, "y", probs, ["sample"]), "sample")


def letter_values(df: DataFrame, columns: Sequence[str], depth: int = 5) -> DataFrame:
    """Boxen summary of log10(x + 1): lower and upper letter values at 1/4, 1/8, ... per sample."""
    long = to_long(df, [], columns).select("sample", F.log10(F.col("value") + 1).alias("y"))
    probs = {"median": 0.5}
    for d in range(2, depth + 2):
        probs[f"lower_{2 ** d}"], probs[f"upper_{2 ** d}"] = 1 / 2 ** d, 1 - 1 / 2 ** d
    return quantiles(long, "y", probs, ["sample"])


# --- histograms ----------------------------------------------------------------------------------------------

def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    width = F.when(high > low, (high - low) / bins).otherwise(F.lit(1.0))
    return F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 100, low: float | None = None,
              high: float | None = None) -> DataFrame:
    """(bin, lower, upper, count) with equal-width bins; the last edge is inclusive, empty bins are kept."""
    require_columns(df, [column])
    x = F.col(column).cast("double")
    clean = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    if low is None or high is None:
        edge = clean.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
        low, high = (edge["lo"] if low is None else low), (edge["hi"] if high is None else high)
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    counts = (clean.filter(F.col("x").between(low, high))
              .groupBy(_bin(F.col("x"), F.lit(low), F.lit(high), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    width = (high - low) / bins
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"), (F.lit(low) + F.col("id") * width).alias("lower"),
                                     (F.lit(low) + (F.col("id") + 1) * width).alias("upper"))
    return frame.join(counts, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("count"))


def pvalue_histogram(df: DataFrame, column: str = "pvalue", bin_size: float = 0.05) -> DataFrame:
    return histogram(df, column, int(1 / bin_size + 1e-9), 0.0, 1.0)


def observed_expected_histogram(long: DataFrame, targets: DataFrame, key: str, bins: int = 100,
                                log_scale: bool = False) -> DataFrame:
    """Per attribute: counts of target and background values in joint bins.

    ``long`` is (attribute, key, value) of the background; ``targets`` holds the target keys.
    """
    value = F.log10(F.col("value") + 1) if log_scale else F.col("value")
    flagged = long.select("attribute", key, value.alias("x")).filter(F.col("x").isNotNull()).join(
        targets.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    edges = flagged.groupBy("attribute").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return (flagged.join(edges, "attribute")
            .groupBy("attribute", _bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"))
            .agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("observed")))


# --- sample comparisons ---------------------------------------------------------------------------------------

def sample_points(df: DataFrame, key: str, x: Sequence[str], y: Sequence[str],
                  highlight: DataFrame | None = None) -> DataFrame:
    """log10(mean + 1) of two samples or groups per feature, with a highlight flag."""
    points = df.select(key, F.log10(arrays.mean(arrays.values(x)) + 1).alias("x"),
                       F.log10(arrays.mean(arrays.values(y)) + 1).alias("y"))
    if highlight is None:
        return points.withColumn("highlight", F.lit(False))
    marked = highlight.select(key).distinct().withColumn("__hit", F.lit(True))
    return points.join(marked, key, "left").select(
        key, "x", "y", F.coalesce("__hit", F.lit(False)).alias("highlight"))


def spearman(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(sample_a, sample_b, rho) for every pair of samples, from average ranks. Keys must be unique."""
    ranked = average_ranks(to_long(df, key, columns), "value", ["sample"])
    wide = to_wide(ranked.select(key, "sample", "rank"), key, columns, value="rank")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = wide.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("sample_a"), F.lit(b).alias("sample_b"), F.col(f"r{i}").alias("rho"))
        for i, (a, b) in enumerate(pairs)])))


def column_sums(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Library sizes; one value per sample."""
    row = df.agg(*[F.sum(c).cast("double").alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"s{i}"] or 0.0 for i, c in enumerate(columns)}
