"""Exact ranks, quantiles and false-discovery-rate correction without one-task sorts.

Everything here starts from the same move: range-partition the rows (or the distinct values) on the ordering
columns, store the partition number as a column, and combine a window inside each partition with offsets taken
from a table that has one row per partition and group. The stored copy is a reliable checkpoint, so partition
numbers cannot change when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .skew import lookup

CHUNK = "__chunk"

INTERPOLATIONS = ("nearest", "higher", "lower", "midpoint", "linear")


def range_chunks(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Range-partition on ``groups`` then ``order`` and keep the partition number in a column."""
    keys = [*[F.col(g) for g in groups], *[F.col(o) if isinstance(o, str) else o for o in order]]
    return checkpoint(df.repartitionByRange(*keys).withColumn(CHUNK, F.spark_partition_id()))


def _chunk_offsets(chunks: DataFrame, groups: Sequence[str], weight: Column) -> DataFrame:
    """Rows that precede each chunk inside its group; one row per chunk and group."""
    per_chunk = chunks.groupBy(*groups, CHUNK).agg(F.sum(weight).alias("__here"))
    w = Window.partitionBy(*groups)
    return per_chunk.select(
        *groups, CHUNK,
        F.coalesce(F.sum("__here").over(w.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__before"),
        F.sum("__here").over(w).alias("group_rows"))


def row_numbers(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column],
                name: str = "row_number") -> DataFrame:
    """1-based row number inside each group, plus ``group_rows``. ``order`` must identify a row."""
    chunks = range_chunks(df, groups, order)
    offsets = _chunk_offsets(chunks, groups, F.lit(1))
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    local = chunks.withColumn("__local", F.row_number().over(Window.partitionBy(*groups, CHUNK).orderBy(*cols)))
    return (local.join(offsets, [*groups, CHUNK])
            .select(*df.columns, (F.col("__local") + F.col("__before")).alias(name), "group_rows"))


def value_ranks(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row per distinct non-null value: ``n_equal``, ``first_rank``, ``last_rank`` (1-based), ``group_rows``.

    Ties are collapsed before the shuffle, so a value that fills a third of the table is one row here.
    """
    groups = list(groups)
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        F.count(F.lit(1)).alias("n_equal"))
    chunks = range_chunks(distinct, groups, [value])
    offsets = _chunk_offsets(chunks, groups, F.col("n_equal"))
    w = Window.partitionBy(*groups, CHUNK).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = chunks.withColumn("__local", F.sum("n_equal").over(w))
    last = F.col("__local") + F.col("__before")
    return local.join(offsets, [*groups, CHUNK]).select(
        *groups, value, "n_equal", (last - F.col("n_equal") + 1).alias("first_rank"), last.alias("last_rank"),
        "group_rows", CHUNK)


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float], groups: Sequence[str] = (),
              interpolation: str = "linear") -> DataFrame:
    """Exact quantiles per group: one row per group, one column per entry of ``probs`` (name -> probability).
    NaN values are ignored."""
    if interpolation not in INTERPOLATIONS:
        raise ValueError(f"interpolation must be one of {INTERPOLATIONS}")
    numeric = df.select(*groups, F.col(value).cast("double").alias(value)).filter(~F.isnan(value))
    return _pick_quantiles(value_ranks(numeric, value, groups), value, probs, groups, interpolation)


def _pick_quantiles(ranks: DataFrame, value: str, probs: Mapping[str, float], groups: Sequence[str],
                    interpolation: str) -> DataFrame:
    def at(index: Column) -> Column:
        inside = (F.col("first_rank") - 1 <= index) & (index <= F.col("last_rank") - 1)
        return F.max(F.when(inside, F.col(value)))

    parts, finish = [], []
    for name, prob in probs.items():
        h = (F.col("group_rows") - 1) * F.lit(float(prob))
        if interpolation == "nearest":
            parts.append(at(F.floor(h + 0.5)).alias(f"{name}__lo"))
            finish.append(F.col(f"{name}__lo").alias(name))
            continue
        parts += [at(F.floor(h)).alias(f"{name}__lo"), at(F.ceil(h)).alias(f"{name}__hi"),
                  F.max(h - F.floor(h)).alias(f"{name}__frac")]
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        finish.append({
            "lower": lo, "higher": hi, "midpoint": (lo + hi) / 2,
            "linear": lo + (hi - lo) * F.col(f"{name}__frac"),
        }[interpolation].alias(name))
    return ranks.groupBy(*groups).agg(*parts).select(*groups, *finish)


def average_ranks(df: DataFrame, value: str, groups: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Attach the average rank of ``value`` inside its group (ties share the mean rank)."""
    ranks = value_ranks(df, value, groups)
    table = ranks.select(*groups, value, ((F.col("first_rank") + F.col("last_rank")) / 2).alias(name))
    heavy = ranks.filter(F.col("n_equal") * 1000 >= F.col("group_rows")).filter(F.col("n_equal") >= 100_000)
    heavy = heavy.select(*groups, value, ((F.col("first_rank") + F.col("last_rank")) / 2).alias(name))
    return lookup(df, table, [*groups, value], heavy)


def fdr_adjust(df: DataFrame, pvalue: str = "pval", groups: Sequence[str] = (), method: str = "bh",
               name: str = "padj") -> DataFrame:
    """Step-up adjusted p-values per group: Benjamini-Hochberg (``bh``) or Benjamini-Yekutieli (``by``).

    Null and NaN p-values are set aside and come back with a null adjusted value.
    """
    if method not in ("bh", "by"):
        raise ValueError("method must be 'bh' or 'by'")
    groups = list(groups)
    clean = df.withColumn("__p", F.when(F.isnan(pvalue), None).otherwise(F.col(pvalue)))
    ranks = value_ranks(clean, "__p", groups)
    raw = F.col("__p") * F.col("group_rows") / F.col("last_rank")
    if method == "by":
        raw = raw * harmonic(F.col("group_rows"))
    scored = ranks.withColumn("__raw", raw)
    per_chunk = scored.groupBy(*groups, CHUNK).agg(F.min("__raw").alias("__here"))
    later = per_chunk.select(*groups, CHUNK, F.min("__here").over(
        Window.partitionBy(*groups).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)).alias("__later"))
    local = scored.withColumn("__suffix", F.min("__raw").over(
        Window.partitionBy(*groups, CHUNK).orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)))
    table = local.join(later, [*groups, CHUNK]).select(
        *groups, "__p", F.least(F.lit(1.0), "__suffix", "__later").alias(name), "n_equal", "group_rows")
    heavy = table.filter((F.col("n_equal") * 1000 >= F.col("group_rows")) & (F.col("n_equal") >= 100_000))
    cols = [*groups, "__p", name]
    return lookup(clean, table.select(*cols), [*groups, "__p"], heavy.select(*cols)).drop("__p")


def harmonic(m: Column) -> Column:
    """Sum of 1/i for i in 1..m, for any m: the asymptotic series of the sum up to m + 16, less its last 16 terms."""
    x = m.cast("double") + 16
    s = 1 / (x * x)
    series = F.log(x) + F.lit(0.57721566490153286) + 1 / (2 * x) - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))
    return series - sum(1 / (m + i) for i in range(1, 17))
