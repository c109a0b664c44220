"""Genome annotation lines (GTF and GFF3) as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import row_order

FIELDS = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame")


def gtf_attributes(text: Column) -> Column:
    """``key "value";`` pairs as a map; the last value of a repeated key wins."""
    keys = F.regexp_extract_all(text, F.lit(r'([^\s;"]+)\s+"([^"]*)"'), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r'([^\s;"]+)\s+"([^"]*)"'), F.lit(2))
    return _last_wins(keys, values)


def gff3_attributes(text: Column) -> Column:
    """``key=value;`` pairs as a map to lists; commas separate list items."""
    parts = F.filter(F.split(text, ";"), lambda p: p.contains("="))
    keys = F.transform(parts, lambda p: F.trim(F.substring_index(p, "=", 1)))
    values = F.transform(parts, lambda p: F.split(F.trim(F.regexp_replace(p, "^[^=]*=", "")), ","))
    return _last_wins(keys, values)


def _last_wins(keys: Column, values: Column) -> Column:
    numbered = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")),
                           lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i")))
    kept = F.filter(numbered, lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.size(keys)), e["k"]))
    deduplicated = F.map_from_arrays(F.transform(kept, lambda e: e["k"]), F.transform(kept, lambda e: e["v"]))
    # most lines repeat no key, so the slower path is rarely evaluated
    return F.when(F.size(keys) == F.size(F.array_distinct(keys)), F.map_from_arrays(keys, values)).otherwise(deduplicated)


def parse_lines(lines: DataFrame, file_type: str, value: str = "value") -> DataFrame:
    """Nine tab fields per line; comments and malformed lines are skipped. Extra columns of ``lines`` are kept."""
    if file_type not in ("gtf", "gff3"):
        raise ValueError("file_type must be gtf or gff3")
    rest = [c for c in lines.columns if c != value]
    parts = F.split(F.rtrim(F.col(value)), "\t")
    rows = lines.filter(~F.col(value).startswith("#")).select(*rest, parts.alias("p")).filter(F.size("p") == 9)
    attrs = (gtf_attributes if file_type == "gtf" else gff3_attributes)(F.get("p", F.lit(8)))
    typed = [F.get("p", F.lit(i)).cast("long" if f in ("start", "end") else "string").alias(f) for i, f in enumerate(FIELDS)]
    return rows.select(*rest, *typed, attrs.alias("attrs"))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Read a ``.gtf`` or ``.gff3`` file (``.gz`` allowed) with its line order in ``_row``."""
    name = path.lower().removesuffix(".gz")
    file_type = "gtf" if name.endswith(".gtf") else "gff3" if name.endswith((".gff3", ".gff")) else None
    if file_type is None:
        raise ValueError("genome annotation must be a .gtf or .gff3 file")
    return parse_lines(spark.read.text(path).select("value", row_order().alias("_row")), file_type)
