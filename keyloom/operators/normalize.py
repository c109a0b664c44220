"""Count-matrix normalisation. Factors are one number per sample, so the result is a projection over the scan."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from .aggregates import column_sums, to_long
from .filters import numeric_columns, require_columns
from .ranking import quantiles, row_numbers

# Counters of the HTSeq-count output that belong to the library size.
LIBRARY_COUNTERS = ("__no_feature", "__alignment_not_unique", "__ambiguous")


def divide(df: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    """Divide each sample column by its factor; a zero factor gives null."""
    require_columns(df, factors)
    return df.withColumns({c: F.col(c) / F.lit(float(f)) if f else F.lit(None).cast("double") for c, f in factors.items()})


def factors_frame(df: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    """The factors as a (sample, factor) table."""
    return df.sparkSession.createDataFrame([(c, float(f)) for c, f in factors.items()], "sample string, factor double")


def _geometric(values: Sequence[float]) -> float:
    return math.exp(sum(math.log(v) for v in values) / len(values)) if all(v > 0 for v in values) else 0.0


def _centred(factors: Mapping[str, float]) -> dict[str, float]:
    """Factors divided by their geometric mean, so that they multiply to 1."""
    g = _geometric(list(factors.values()))
    return {c: f / g for c, f in factors.items()}


def rpm_factors(df: DataFrame, samples: Sequence[str], special: DataFrame | None = None,
                special_key: str | None = None) -> dict[str, float]:
    """Library size in millions, optionally with the counters of reads that hit no feature."""
    totals = column_sums(df, samples)
    if special is not None:
        extra = column_sums(special.filter(F.col(special_key or special.columns[0]).isin(*LIBRARY_COUNTERS)), samples)
        totals = {c: totals[c] + extra[c] for c in samples}
    return {c: t / 1e6 for c, t in totals.items()}


def normalize_to_rpm(df: DataFrame, key: str, samples: Sequence[str] | None = None) -> DataFrame:
    return divide(df, rpm_factors(df, samples or numeric_columns(df, [key])))


def normalize_to_rpm_htseqcount(df: DataFrame, key: str, special: DataFrame, special_key: str | None = None,
                                samples: Sequence[str] | None = None) -> DataFrame:
    return divide(df, rpm_factors(df, samples or numeric_columns(df, [key]), special, special_key))


def _with_length(df: DataFrame, key: str, lengths: DataFrame, length: str) -> DataFrame:
    """Join lengths in kilobases; features without a length get null."""
    kbp = lengths.select(F.col(key), (F.col(length) / 1000.0).alias("__kbp"))
    return df.join(kbp, key, "left")


def normalize_to_rpkm(df: DataFrame, key: str, lengths: DataFrame, length: str = "length",
                      samples: Sequence[str] | None = None) -> DataFrame:
    """Reads per kilobase and million. ``lengths`` has one row per feature (key, length in bases)."""
    samples = samples or numeric_columns(df, [key])
    millions = rpm_factors(df, samples)
    return _with_length(df, key, lengths, length).withColumns(
        {c: F.col(c) / (F.lit(millions[c]) * F.col("__kbp")) for c in samples}).drop("__kbp")


def normalize_to_tpm(df: DataFrame, key: str, lengths: DataFrame, length: str = "length",
                     samples: Sequence[str] | None = None) -> DataFrame:
    samples = samples or numeric_columns(df, [key])
    rates = _with_length(df, key, lengths, length).withColumns({c: F.col(c) / F.col("__kbp") for c in samples})
    return divide(rates.drop("__kbp"), rpm_factors(rates, samples))


def quantile_factors(df: DataFrame, samples: Sequence[str], quantile: float = 0.75) -> dict[str, float]:
    nonzero = df.filter(F.greatest(*[F.coalesce(F.abs(c), F.lit(0)) for c in samples], F.lit(0)) > 0)
    q = _sample_quantiles(to_long(nonzero, [], samples), quantile, samples)
    centre = sum(q.values()) / len(q)
    return {c: v / centre for c, v in q.items()}


def _sample_quantiles(long: DataFrame, prob: float, samples: Sequence[str],
                      interpolation: str = "linear") -> dict[str, float]:
    """One number per sample, brought to the driver as factors."""
    rows = {r["sample"]: r["q"] for r in quantiles(long, "value", {"q": prob}, ["sample"], interpolation).collect()}
    return {c: rows.get(c, math.nan) for c in samples}


def normalize_to_quantile(df: DataFrame, key: str, quantile: float = 0.75,
                          samples: Sequence[str] | None = None) -> DataFrame:
    return divide(df, quantile_factors(df, samples or numeric_columns(df, [key]), quantile))


# --- trimmed mean of M values ----------------------------------------------------------------------------------

def reference_sample(df: DataFrame, samples: Sequence[str], ref: str | int = "auto") -> str:
    """A sample by name or index; ``auto`` takes the one whose upper quartile is closest to the mean quartile."""
    if isinstance(ref, int):
        return samples[ref]
    if ref != "auto":
        require_columns(df, [ref])
        return ref
    q = _sample_quantiles(to_long(df, [], samples), 0.75, samples, "nearest")
    centre = sum(q.values()) / len(q)
    return min(samples, key=lambda c: (abs(q[c] - centre), samples.index(c)))


def ma_table(df: DataFrame, key: str, samples: Sequence[str], ref: str) -> DataFrame:
    """(key, sample, m, a, weight) on library-scaled values; rows without reads in ``ref`` are left out and
    entries that would be infinite are null. The weight is the inverse of the approximate variance."""
    used = df.filter(F.col(ref) > 0)
    totals = column_sums(used, samples)
    r, r_raw = F.col(ref) / F.lit(totals[ref]), F.col(ref)
    rows = []
    for c in samples:
        raw = F.when(F.col(c) > 0, F.col(c).cast("double"))
        x = raw / F.lit(totals[c] or 1.0)
        rows.append(F.struct(F.lit(c).alias("sample"), F.log2(x / r).alias("m"), (F.log2(x * r) / 2).alias("a"),
                             (1 / F.nullif((1 - x) / raw + (1 - r) / r_raw, F.lit(0.0))).alias("weight")))
    return used.select(key, F.inline(F.array(*rows)))


def tmm_factors(df: DataFrame, key: str, samples: Sequence[str], log_ratio_trim: float = 0.3, sum_trim: float = 0.05,
                a_cutoff: float | None = -1e10, ref: str | int = "auto") -> dict[str, float]:
    if not (0 <= log_ratio_trim < 0.5 and 0 <= sum_trim < 0.5):
        raise ValueError("trims must lie in [0, 0.5)")
    ref = reference_sample(df, samples, ref)
    table = ma_table(df, key, samples, ref).filter("m is not null and a is not null")
    if a_cutoff is not None:
        table = table.filter(F.col("a") > a_cutoff)

    def inside(value: str, trim: float) -> DataFrame:
        ranked = row_numbers(table.select(key, "sample", value), ["sample"], [value, key], "__rank")
        cut = F.ceil(F.col("group_rows") * F.lit(trim))
        return ranked.filter((F.col("__rank") > cut) & (F.col("__rank") <= F.col("group_rows") - cut)).select(key, "sample")

    kept = table.join(inside("m", log_ratio_trim), [key, "sample"]).join(inside("a", sum_trim), [key, "sample"])
    means = {r["sample"]: r["tmm"] for r in kept.groupBy("sample").agg(
        (F.sum(F.col("m") * F.col("weight")) / F.sum("weight")).alias("tmm")).collect()}
    return _centred({c: 2 ** (means.get(c) or 0.0) for c in samples})


def normalize_tmm(df: DataFrame, key: str, log_ratio_trim: float = 0.3, sum_trim: float = 0.05,
                  a_cutoff: float | None = -1e10, ref: str | int = "auto",
                  samples: Sequence[str] | None = None) -> DataFrame:
    samples = samples or numeric_columns(df, [key])
    return divide(df, tmm_factors(df, key, samples, log_ratio_trim, sum_trim, a_cutoff, ref))


# --- ratio methods ------------------------------------------------------------------------------------------------

def rle_factors(df: DataFrame, samples: Sequence[str]) -> dict[str, float]:
    """Median ratio to the row's geometric mean; rows with a zero drop out."""
    positive = df.filter(F.least(*[F.coalesce(F.col(c), F.lit(0)) for c in samples], F.lit(float("inf"))) > 0)
    centre = arrays.geometric_mean(arrays.values(samples))
    ratios = positive.select(*[(F.col(c) / centre).alias(c) for c in samples])
    factors = _sample_quantiles(to_long(ratios, [], samples), 0.5, samples)
    if any(math.isnan(v) for v in factors.values()):
        raise ValueError("every feature has a zero in some sample; relative log expression is undefined")
    return factors


def normalize_rle(df: DataFrame, key: str, samples: Sequence[str] | None = None) -> DataFrame:
    return divide(df, rle_factors(df, samples or numeric_columns(df, [key])))


def median_of_ratios_factors(df: DataFrame, groups: Sequence[Sequence[str]], reference: int = 0) -> dict[str, float]:
    """Median ratio of group mean shares to the reference group, times the library size, centred."""
    samples = [c for g in groups for c in g]
    if not 0 <= reference < len(groups):
        raise ValueError("reference group out of range")
    totals = column_sums(df, samples)

    def share(g: Sequence[str]):
        return sum((F.col(c) / F.lit(totals[c]) for c in g), F.lit(0.0)) / len(g)

    names = [f"g{i}" for i in range(len(groups))]
    shares = df.select(*[share(g).alias(n) for n, g in zip(names, groups)])
    ratios = shares.filter(F.col(names[reference]) > 0).select(
        *[(F.col(n) / F.col(names[reference])).alias(f"r{n}") for n in names])
    medians = _sample_quantiles(to_long(ratios, [], [f"r{n}" for n in names]), 0.5, [f"r{n}" for n in names])
    return _centred({c: medians[f"rg{i}"] * totals[c] for i, g in enumerate(groups) for c in g})


def normalize_median_of_ratios(df: DataFrame, groups: Sequence[Sequence[str]], reference: int = 0) -> DataFrame:
    return divide(df, median_of_ratios_factors(df, groups, reference))


def normalize_with_scaling_factors(df: DataFrame, key: str, factors: Mapping[str, float] | DataFrame,
                                   samples: Sequence[str] | None = None) -> DataFrame:
    """Given factors: a mapping, a one-row table (a column per sample) or a keyed matrix (key plus samples)."""
    samples = samples or numeric_columns(df, [key])
    if isinstance(factors, DataFrame):
        if key in factors.columns:
            scale = factors.select(key, *[F.col(c).alias(f"__f_{c}") for c in samples])
            return df.join(scale, key, "left").select(
                *[(F.col(c) / F.col(f"__f_{c}")).alias(c) if c in samples else F.col(c) for c in df.columns])
        row = factors.select(*samples).first()
        factors = {c: row[c] for c in samples}
    return divide(df, factors)
