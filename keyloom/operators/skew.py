"""Joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

SALT = "__salt"


def heavy_keys(df: DataFrame, on: Sequence[str], share: float = 1e-3, floor: int = 100_000) -> DataFrame:
    """Keys holding at least ``share`` of the rows. At most ``1/share`` keys can qualify, so the result may
    be broadcast whatever the size of ``df``."""
    counts = checkpoint(df.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows")))
    total = counts.agg(F.sum("__rows")).first()[0] or 0
    return counts.filter(F.col("__rows") >= max(floor, int(total * share))).select(*on)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], salt_by: Sequence[str], salts: int = 32,
                heavy: DataFrame | None = None) -> DataFrame:
    """Inner equi-join that spreads the heavy keys of ``left`` over ``salts`` tasks.

    Rows of ``left`` with a heavy key get a salt from a hash of ``salt_by``; the matching rows of ``right``
    are copied once per salt. All other rows keep salt 0, so nothing else is copied.
    """
    on = list(on)
    if heavy is None:
        heavy = heavy_keys(left, on)
    flag = F.broadcast(heavy.select(*on).distinct().withColumn("__heavy", F.lit(True)))
    salted_left = left.join(flag, on, "left").withColumn(
        SALT, F.when(F.col("__heavy"), F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    ).drop("__heavy")
    salted_right = right.join(flag, on, "left").withColumn(
        SALT, F.explode(F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("__heavy")
    return salted_left.join(salted_right, [*on, SALT], "inner").drop(SALT)


def lookup(df: DataFrame, ref: DataFrame, on: Sequence[str], heavy: DataFrame, salts: int = 64) -> DataFrame:
    """Left-join ``ref`` (one row per key) onto ``df``.

    ``heavy`` is the bounded subset of ``ref`` whose keys repeat most in ``df``. Those rows are answered from
    a broadcast; in the shuffled join they are scattered by a salt because they need no partner there. So are rows with a
    null in their key, which match nothing.
    """
    on = list(on)
    values = [c for c in ref.columns if c not in on]
    hot = F.broadcast(heavy.select(*on, *[F.col(c).alias(f"__hot_{c}") for c in values], F.lit(True).alias("__heavy")))
    spread = F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    unmatched = reduce(or_, [F.col(c).isNull() for c in on])
    tagged = df.join(hot, on, "left").withColumn(
        SALT, F.when(F.col("__heavy") | unmatched, 1 + F.pmod(spread, F.lit(salts))).otherwise(F.lit(0)).cast("long"))
    # a literal zero would be folded out of the join keys and the heavy rows would meet again in one task
    joined = tagged.join(ref.withColumn(SALT, F.pmod(F.xxhash64(*on), F.lit(1))), [*on, SALT], "left")
    picked = [F.when(F.col("__heavy"), F.col(f"__hot_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return joined.select(*df.columns, *picked)


def grid(left: DataFrame, right: DataFrame, parts: int = 64) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, for results that have a row for each such pair.

    ``left`` is dealt to ``parts`` parts and ``right`` copied to each of them, so it is an equi-join of parts; neither side
    is broadcast unless Spark finds it small, or brought to the driver.
    """
    dealt = left.withColumn(SALT, F.pmod(F.xxhash64(*left.columns), F.lit(parts)).cast("int"))
    copied = right.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copied, SALT).drop(SALT)
