"""Ordering, top-n and first/last rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import complement, require_columns


def order_columns(by: str | Sequence[str], ascending: bool | Sequence[bool] = True,
                  na_position: str = "last") -> list[Column]:
    by = [by] if isinstance(by, str) else list(by)
    directions = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    if len(directions) != len(by):
        raise ValueError("one direction per sort column")
    if na_position not in ("first", "last"):
        raise ValueError("na_position must be first or last")
    method = {(True, "last"): "asc_nulls_last", (True, "first"): "asc_nulls_first",
              (False, "last"): "desc_nulls_last", (False, "first"): "desc_nulls_first"}
    return [getattr(F.col(c), method[bool(d), na_position])() for c, d in zip(by, directions)]


def sort(df: DataFrame, by: str | Sequence[str], ascending: bool | Sequence[bool] = True,
         na_position: str = "last") -> DataFrame:
    require_columns(df, [by] if isinstance(by, str) else by)
    return df.orderBy(*order_columns(by, ascending, na_position))


def filter_top_n(df: DataFrame, key: str, by: str | Sequence[str], n: int = 100,
                 ascending: bool | Sequence[bool] = True, na_position: str = "last",
                 opposite: bool = False) -> DataFrame:
    """First ``n`` rows after sorting; ascending by default, so "top" means smallest. The key breaks ties."""
    require_columns(df, [by] if isinstance(by, str) else by)
    top = df.orderBy(*order_columns(by, ascending, na_position), F.col(key).asc()).limit(n)
    return complement(df, top, key) if opposite else top


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.col(c).asc() for c in order]).limit(n)


def tail(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
