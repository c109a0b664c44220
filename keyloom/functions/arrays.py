"""Row-wise statistics over a fixed list of columns. No shuffle: each uses only the row it is in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def values(columns: Sequence[str]) -> Column:
    """Non-null values of the columns as an array of doubles."""
    return F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def mean(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, total(arr) / F.size(arr))


def _spread(arr: Column, ddof: int) -> Column:
    m = mean(arr)
    n = F.size(arr)
    return F.when(n > ddof, F.sqrt(total(F.transform(arr, lambda x: (x - m) * (x - m))) / (n - ddof)))


def std(arr: Column) -> Column:
    return _spread(arr, 1)


def std_pop(arr: Column) -> Column:
    return _spread(arr, 0)


def log_values(arr: Column) -> Column:
    return F.transform(arr, lambda x: F.ln(x))


def geometric_mean(arr: Column) -> Column:
    """exp(mean(ln x)); 0 as soon as one value is 0."""
    has_zero = F.exists(arr, lambda x: x <= 0)
    return F.when(has_zero, F.lit(0.0)).otherwise(F.exp(mean(log_values(arr))))


def quantile(arr: Column, prob: float, interpolation: str = "linear") -> Column:
    ordered = F.array_sort(arr)
    h = (F.size(arr) - 1) * F.lit(float(prob))

    def at(i: Column) -> Column:
        return F.element_at(ordered, i.cast("int") + 1)

    lo, hi = at(F.floor(h)), at(F.ceil(h))
    picked = {
        "lower": lo, "higher": hi, "midpoint": (lo + hi) / 2, "nearest": at(F.floor(h + 0.5)),
        "linear": lo + (hi - lo) * (h - F.floor(h)),
    }[interpolation]
    return F.when(F.size(arr) > 0, picked)


def median(arr: Column) -> Column:
    return quantile(arr, 0.5)


AVERAGES = {"mean": mean, "median": median, "geometric_mean": geometric_mean}
