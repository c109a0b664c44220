"""Selecting features by attribute, biotype, ontology term or pathway. Attribute tables are long: (attribute, key)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import complement


def attributes_to_long(table: DataFrame, key: str, columns: Sequence[str] | None = None,
                       with_value: bool = False) -> DataFrame:
    """Wide reference table to (attribute, key[, value]); null and NaN cells mean "does not have it"."""
    columns = list(columns or [c for c in table.columns if c != key])
    kinds = dict(table.dtypes)

    def cell(c):
        raw = F.col(f"`{c}`")
        return F.when(~F.isnan(raw), raw) if kinds[c] in ("double", "float") else raw

    kind = "double" if with_value else "string"
    rows = table.select(key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("attribute"), cell(c).cast(kind).alias("value")) for c in columns])))
    rows = rows.filter("value is not null").select("attribute", key, "value")
    return rows if with_value else rows.drop("value")


def select_attributes(long: DataFrame, attributes: str | Sequence[str | int]) -> DataFrame:
    """Attributes by name, by position in sorted name order, or ``all``; unknown ones are an error."""
    if attributes == "all":
        return long
    wanted = [attributes] if isinstance(attributes, (str, int)) else list(attributes)
    names = [row["attribute"] for row in long.select("attribute").distinct().orderBy("attribute").collect()] \
        if any(isinstance(a, int) for a in wanted) else None
    if any(isinstance(a, int) and a < 0 for a in wanted):
        raise ValueError("attribute positions must not be negative")
    resolved = [names[a] if isinstance(a, int) else a for a in wanted]
    known = {row["attribute"] for row in long.filter(F.col("attribute").isin(resolved)).select("attribute").distinct().collect()}
    unknown = [a for a in resolved if a not in known]
    if unknown:
        raise ValueError(f"unknown attributes: {unknown}")
    return long.filter(F.col("attribute").isin(resolved))


def keys_with(long: DataFrame, key: str, attributes: Sequence[str], mode: str = "union") -> DataFrame:
    """Keys having any (``union``) or all (``intersection``) of the attributes."""
    if mode not in ("union", "intersection"):
        raise ValueError("mode must be union or intersection")
    hits = long.filter(F.col("attribute").isin(list(attributes))).select(key, "attribute").distinct()
    if mode == "union":
        return hits.select(key).distinct()
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(set(attributes))).select(key)


def filter_by_attribute(df: DataFrame, key: str, long: DataFrame, attributes: str | Sequence[str],
                        mode: str = "union", opposite: bool = False) -> DataFrame:
    names = [attributes] if isinstance(attributes, str) else list(attributes)
    kept = df.join(keys_with(long, key, names, mode), key, "left_semi")
    return complement(df, kept, key) if opposite else kept


def split_by_attribute(df: DataFrame, key: str, long: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """All parts in one table with the column ``attribute``; parts may overlap. Filter on it to get one part."""
    hits = long.filter(F.col("attribute").isin(list(attributes))).select(key, "attribute").distinct()
    return df.join(hits, key)


def filter_by_biotype(df: DataFrame, key: str, reference: DataFrame, biotype: str | Sequence[str],
                      ref_key: str = "key", column: str = "biotype", opposite: bool = False) -> DataFrame:
    names = [biotype] if isinstance(biotype, str) else list(biotype)
    legal = reference.filter(F.col(column).isin(names))
    known = {row[column] for row in legal.select(column).distinct().collect()}
    if set(names) - known:
        raise ValueError(f"unknown biotypes: {sorted(set(names) - known)}")
    kept = df.join(legal.select(F.col(ref_key).alias(key)), key, "left_semi")
    return complement(df, kept, key) if opposite else kept


def filter_by_pathway(df: DataFrame, key: str, members: DataFrame, pathways: str | Sequence[str],
                      mode: str = "union", opposite: bool = False) -> DataFrame:
    """``members`` is (pathway, key)."""
    return filter_by_attribute(df, key, members.withColumnRenamed("pathway", "attribute"), pathways, mode, opposite)


def filter_by_terms(df: DataFrame, key: str, annotations: DataFrame, terms: str | Sequence[str],
                    closure: DataFrame | None = None, mode: str = "union", opposite: bool = False) -> DataFrame:
    """``annotations`` is (term, key); with ``closure`` (term, ancestor) it is carried up the ontology first."""
    from .ontology import propagate
    rows = propagate(annotations, closure, key) if closure is not None else annotations
    return filter_by_attribute(df, key, rows.withColumnRenamed("term", "attribute"), terms, mode, opposite)
