"""Set algebra on feature IDs. Operands are DataFrames whose column ``key`` holds the IDs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import complement


def key_set(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).filter(F.col(key).isNotNull()).distinct()


def _tagged(sets: Sequence[DataFrame], key: str) -> DataFrame:
    """(key, member) with one row per key and set it occurs in; ``member`` numbers the sets from 0."""
    tagged = None
    for i, s in enumerate(sets):
        part = s.select(F.col(s.columns[0] if key not in s.columns else key).alias(key), F.lit(i).alias("member"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.filter(F.col(key).isNotNull()).distinct()


def membership(sets: Sequence[DataFrame], key: str) -> DataFrame:
    """One row per key: the sorted numbers of the sets that hold it, and how many. One shuffle for any number of sets."""
    return _tagged(sets, key).groupBy(key).agg(F.array_sort(F.collect_list("member")).alias("members"), F.count(F.lit(1)).alias("n_sets"))


def union(sets: Sequence[DataFrame], key: str) -> DataFrame:
    return _tagged(sets, key).select(key).distinct()


def intersection(sets: Sequence[DataFrame], key: str) -> DataFrame:
    return membership(sets, key).filter(F.col("n_sets") == len(sets)).select(key)


def intersect_rows(df: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    """The rows of ``df`` whose key occurs in every other set."""
    for other in others:
        df = df.join(key_set(other, key), key, "left_semi")
    return df


def difference(first: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    return membership([first, *others], key).filter(F.col("members") == F.array(F.lit(0))).select(key)


def difference_rows(df: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    for other in others:
        df = complement(df, other, key)
    return df


def symmetric_difference(sets: Sequence[DataFrame], key: str) -> DataFrame:
    if len(sets) != 2:
        raise TypeError("symmetric difference takes exactly two sets")
    return membership(sets, key).filter("n_sets = 1").select(key)


def majority_vote_intersection(sets: Sequence[DataFrame], key: str, majority_threshold: float = 0.5) -> DataFrame:
    """Keys found in at least the given share of the sets."""
    if not 0 <= majority_threshold <= 1:
        raise ValueError("majority_threshold must lie between 0 and 1")
    needed = majority_threshold * len(sets) - 1e-9
    return membership(sets, key).filter(F.col("n_sets") >= needed).select(key)


def intersection_nonempty(sets: Sequence[DataFrame], key: str) -> DataFrame:
    """Intersection that ignores empty operands."""
    used = [s for s in sets if not key_set(s, key).isEmpty()]
    return intersection(used, key) if used else key_set(sets[0], key)


def exclusive_intersections(sets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Size of every membership pattern: ``(mask, sets, size)`` for all 2^n - 1 patterns, zero sizes included."""
    names, spark = list(sets), next(iter(sets.values())).sparkSession
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    mask = F.aggregate("members", F.lit(0).cast("long"), lambda m, i: m + bit(i))
    sizes = membership(list(sets.values()), key).groupBy("members").agg(F.count(F.lit(1)).alias("size")).select(mask.alias("mask"), "size")
    label = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.col("mask").bitwiseAND(bit(i)) != 0),
                                     lambda i: F.get(F.array(*[F.lit(n) for n in names]), i)), ";")
    patterns = spark.range(1, 1 << len(names)).select(F.col("id").alias("mask")).withColumn("sets", label)
    return patterns.join(sizes, "mask", "left").select("mask", "sets", F.coalesce("size", F.lit(0)).alias("size"))


def venn(sets: Mapping[str, DataFrame], key: str) -> DataFrame:
    if not 2 <= len(sets) <= 3:
        raise ValueError("a Venn diagram takes two or three sets")
    return exclusive_intersections(sets, key)


def concatenate(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both tables; same columns and disjoint keys are required."""
    if set(a.columns) != set(b.columns):
        raise ValueError("tables must have the same columns")
    if not key_set(a, key).join(key_set(b, key), key, "left_semi").isEmpty():
        raise ValueError("tables share feature IDs")
    return a.unionByName(b)


def to_text(df: DataFrame, key: str) -> DataFrame:
    """One string of sorted IDs, one per line. The result is a single cell, for sets meant to be read by people;
    use :func:`keyloom.sources.tables.write_id_list` for large sets."""
    return key_set(df, key).agg(
        F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), "\n").alias("ids"))
