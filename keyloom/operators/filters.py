"""Row filters, key complements and splits over feature tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import quantiles

NUMBER_OPERATORS = {
    "gt": ("gt", ">", "greater than"),
    "eq": ("eq", "=", "equals", "equal"),
    "lt": ("lt", "<", "lesser than"),
    "abs_gt": ("abs_gt", "abs greater than", "|x|>"),
}
TEXT_OPERATORS = {
    "equals": ("equals", "equal", "eq", "="),
    "contains": ("contains", "ct", "in"),
    "starts_with": ("starts with", "begins with", "sw"),
    "ends_with": ("ends with", "ew"),
}


def _operator(name: str, table: dict[str, tuple[str, ...]]) -> str:
    wanted = name.lower()
    for canonical, aliases in table.items():
        if wanted in aliases:
            return canonical
    raise ValueError(f"unknown operator {name!r}")


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not in table: {missing}")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def complement(df: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``kept``. Null predicates land here; null keys never do."""
    return df.filter(F.col(key).isNotNull()).join(kept.select(key).distinct(), key, "left_anti").select(*df.columns)


def keep(df: DataFrame, predicate: Column, key: str, opposite: bool = False) -> DataFrame:
    kept = df.filter(predicate)
    return complement(df, kept, key) if opposite else kept


def number_predicate(column: str, operator: str, value: float) -> Column:
    op, c = _operator(operator, NUMBER_OPERATORS), F.col(column)
    return {"gt": c > value, "eq": c == value, "lt": c < value, "abs_gt": F.abs(c) > value}[op]


def number_filters(df: DataFrame, key: str, column: str, operator: str = "greater than", value: float = 0,
                   opposite: bool = False) -> DataFrame:
    require_columns(df, [column])
    return keep(df, number_predicate(column, operator, value), key, opposite)


def text_filters(df: DataFrame, key: str, column: str, operator: str, value: str, literal: bool = False,
                 opposite: bool = False) -> DataFrame:
    """``contains`` matches a regular expression unless ``literal`` is set."""
    require_columns(df, [column])
    op, c = _operator(operator, TEXT_OPERATORS), F.col(column)
    if op == "equals":
        predicate = c == value
    elif op == "contains":
        predicate = c.contains(value) if literal else c.rlike(value)
    elif op == "starts_with":
        predicate = c.startswith(value)
    else:
        predicate = c.endswith(value)
    return keep(df, predicate, key, opposite)


def filter_missing_values(df: DataFrame, key: str, columns: str | Sequence[str] = "all",
                          opposite: bool = False) -> DataFrame:
    """Drop rows with a null in any of ``columns`` (NaN is a value here, unlike ``DataFrame.na.drop``)."""
    if columns == "all":
        columns = df.columns
    elif isinstance(columns, str):
        columns = [columns]
    require_columns(df, columns)
    predicate = F.lit(True)
    for c in columns:
        predicate = predicate & F.col(c).isNotNull()
    return keep(df, predicate, key, opposite)


def filter_by_row_name(df: DataFrame, key: str, row_names: str | Sequence[str] | DataFrame,
                       opposite: bool = False) -> DataFrame:
    """Remove the named rows. A DataFrame of names (first column) is anti-joined."""
    names = [row_names] if isinstance(row_names, str) else row_names
    table = names if isinstance(names, DataFrame) else df.sparkSession.createDataFrame(
        [(n,) for n in names], T.StructType([T.StructField(key, df.schema[key].dataType)]))
    kept = complement(df, table.toDF(key) if len(table.columns) == 1 else table.select(key), key)
    return complement(df, kept, key) if opposite else kept


def filter_duplicate_ids(df: DataFrame, key: str, order: Sequence[str], keep_policy: str = "first",
                         opposite: bool = False) -> DataFrame:
    """One row per key by row order (``first``/``last``), or only keys that occur once (``neither``).

    A min/max over the ordered struct combines before the shuffle, so a repeated key never gathers in one task.
    """
    if keep_policy not in ("first", "last", "neither"):
        raise ValueError("keep_policy must be first, last or neither")
    rest = [c for c in df.columns if c not in (key, *order)]
    row = F.struct(*order, *rest)
    pick = F.max(row) if keep_policy == "last" else F.min(row)
    best = df.groupBy(key).agg(pick.alias("__row"), F.count(F.lit(1)).alias("__n"))
    if keep_policy == "neither":
        best = best.filter("__n = 1")
    kept = best.select(key, "__row.*").select(*df.columns)
    return complement(df, kept, key) if opposite else kept


def drop_columns(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    columns = [columns] if isinstance(columns, str) else list(columns)
    require_columns(df, columns)
    return df.drop(*columns)


def filter_percentile(df: DataFrame, key: str, percentile: float, column: str, interpolation: str = "linear",
                      opposite: bool = False) -> DataFrame:
    """Keep rows with ``column`` at or below its exact quantile."""
    if not 0 <= percentile <= 1:
        raise ValueError("percentile must lie between 0 and 1")
    require_columns(df, [column])
    # One row, one column: the cut is fetched as a scalar so that the filter reaches the scan.
    cut = quantiles(df, column, {"q": percentile}, interpolation=interpolation).first()["q"]
    predicate = F.col(column) <= F.lit(cut) if cut is not None else F.lit(False)
    return keep(df, predicate, key, opposite)


def split_by_percentile(df: DataFrame, key: str, percentile: float, column: str,
                        interpolation: str = "linear") -> tuple[DataFrame, DataFrame]:
    below = filter_percentile(df, key, percentile, column, interpolation)
    return below, complement(df, below, key)


# --- differential-expression and fold-change tables ---------------------------------------------------------

def filter_significant(df: DataFrame, key: str, alpha: float = 0.1, padj: str = "padj",
                       opposite: bool = False) -> DataFrame:
    require_columns(df, [padj])
    return keep(df, F.col(padj) <= alpha, key, opposite)


def filter_abs_log2_fold_change(df: DataFrame, key: str, threshold: float = 1, column: str = "log2FoldChange",
                                is_fold_change: bool = False, opposite: bool = False) -> DataFrame:
    require_columns(df, [column])
    value = F.log2(column) if is_fold_change else F.col(column)
    return keep(df, F.abs(value) >= threshold, key, opposite)


def fold_change_direction(column: str, direction: str, is_fold_change: bool = False) -> Column:
    centre = 1 if is_fold_change else 0
    if direction not in ("pos", "neg"):
        raise ValueError("direction must be 'pos' or 'neg'")
    return F.col(column) > centre if direction == "pos" else F.col(column) < centre


def filter_fold_change_direction(df: DataFrame, key: str, direction: str = "pos", column: str = "log2FoldChange",
                                 is_fold_change: bool = False, opposite: bool = False) -> DataFrame:
    require_columns(df, [column])
    return keep(df, fold_change_direction(column, direction, is_fold_change), key, opposite)


def split_fold_change_direction(df: DataFrame, key: str, column: str = "log2FoldChange",
                                is_fold_change: bool = False) -> tuple[DataFrame, DataFrame]:
    """(positive, negative); rows with no change are in neither."""
    return tuple(filter_fold_change_direction(df, key, d, column, is_fold_change) for d in ("pos", "neg"))


def volcano(df: DataFrame, alpha: float = 0.1, log2fc_threshold: float = 1, log2fc: str = "log2FoldChange",
            padj: str = "padj") -> DataFrame:
    """Add ``neg_log10_padj`` (infinite for 0) and the class ``up`` / ``down`` / ``neutral``."""
    significant = F.col(padj) <= alpha
    return df.withColumns({
        "neg_log10_padj": F.when(F.col(padj) == 0, float("inf")).otherwise(-F.log10(padj)),
        "direction": F.when(significant & (F.col(log2fc) >= log2fc_threshold), "up")
        .when(significant & (F.col(log2fc) <= -log2fc_threshold), "down").otherwise("neutral"),
    })


# --- count matrices --------------------------------------------------------------------------------------

def filter_low_reads(df: DataFrame, key: str, threshold: float = 5, n_samples: int = 1,
                     samples: Sequence[str] | None = None, opposite: bool = False) -> DataFrame:
    samples = samples or numeric_columns(df, [key])
    enough = sum((F.when(F.col(c) >= threshold, 1).otherwise(0) for c in samples), F.lit(0)) >= n_samples
    return keep(df, enough, key, opposite)


def split_by_reads(df: DataFrame, key: str, threshold: float = 5,
                   samples: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    samples = samples or numeric_columns(df, [key])
    top = F.greatest(*samples) if len(samples) > 1 else F.col(samples[0])
    return df.filter(top >= threshold), df.filter(top < threshold)


def row_sum(samples: Sequence[str]) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in samples), F.lit(0))


def filter_by_row_sum(df: DataFrame, key: str, threshold: float = 5, samples: Sequence[str] | None = None,
                      opposite: bool = False) -> DataFrame:
    return keep(df, row_sum(samples or numeric_columns(df, [key])) >= threshold, key, opposite)


# --- key tests -------------------------------------------------------------------------------------------

def contains_key(df: DataFrame, key: str, value) -> bool:
    return not df.filter(F.col(key) == value).limit(1).isEmpty()


def shape(df: DataFrame) -> tuple[int, int]:
    """Rows and data columns (the key is not counted)."""
    return df.count(), len(df.columns) - 1


def tables_equal(a: DataFrame, b: DataFrame) -> bool:
    """Same columns and the same rows with the same multiplicity."""
    if a.columns != b.columns:
        return False
    marked = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(-1)))
    return marked.groupBy(*a.columns).agg(F.sum("__side").alias("d")).filter("d <> 0").isEmpty()


def is_unique_key(df: DataFrame, key: str) -> bool:
    return df.groupBy(key).count().filter("count > 1").isEmpty()
