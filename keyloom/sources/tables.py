"""Feature-table files: delimited text and parquet in, the same out, and per-sample count folders."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that mean "missing" and the suffixes that can be read.
NULL_TOKENS = ("nan", "NaN", "NA")
SEPARATORS = {".csv": ",", ".tsv": "\t"}
# Special counters of the HTSeq-count output.
SPECIAL_COUNTERS = ("__no_feature", "__ambiguous", "__alignment_not_unique", "__too_low_aQual", "__not_aligned")

ROW = "_row"


def row_order() -> Column:
    """A sortable position of each line of a text source: file, block offset, then line within the block."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line"))


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The most frequent candidate separator in the first line."""
    first = spark.read.text(path).first()
    line = first["value"] if first else ""
    return max(("\t", ",", ";", "|", " "), key=line.count)


def clean_text(df: DataFrame) -> DataFrame:
    """Trim string columns; blanks and missing tokens become null."""
    def fix(name: str) -> Column:
        text = F.trim(F.col(f"`{name}`"))
        return F.when(text.isin("", *NULL_TOKENS), None).otherwise(text).alias(name)
    return df.select(*[fix(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def infer_types(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Cast string columns to long or double when every non-null cell allows it. One aggregate for all columns."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not text:
        return df
    checks = []
    for i, c in enumerate(text):
        col = F.col(f"`{c}`")
        checks += [F.coalesce(F.bool_and(col.try_cast("long").isNotNull() | col.isNull()), F.lit(False)).alias(f"l{i}"),
                   F.coalesce(F.bool_and(col.try_cast("double").isNotNull() | col.isNull()), F.lit(False)).alias(f"d{i}"),
                   F.count(col).alias(f"n{i}")]
    row = df.agg(*checks).first()
    kinds = {c: "long" if row[f"l{i}"] else "double" if row[f"d{i}"] else "string" for i, c in enumerate(text)
             if row[f"n{i}"]}
    return df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if kinds.get(c, "string") != "string" else F.col(f"`{c}`")
                       for c in df.columns])


def load_table(spark: SparkSession, path: str, drop_columns: str | Sequence[str] = (), comment: str | None = None,
               schema: T.StructType | None = None, keep_order: bool = False) -> DataFrame:
    """Read ``.csv``, ``.tsv``, ``.txt`` (separator sniffed) or ``.parquet``. The first column is the key.

    Without ``schema`` types are inferred in one pass; give a schema for large inputs. ``keep_order`` adds the
    column ``_row`` that sorts rows in file order.
    """
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".parquet":
        df = spark.read.parquet(path)
        if keep_order:
            df = df.withColumn(ROW, F.struct(F.col("_metadata.file_path").alias("path"),
                                             F.col("_metadata.row_index").alias("line")))
        if "__index_level_0__" in df.columns:
            rest = [c for c in df.columns if c != "__index_level_0__"]
            df = df.select(F.col("__index_level_0__").alias("key"), *rest)
    elif suffix in (*SEPARATORS, ".txt"):
        sep = SEPARATORS.get(suffix) or sniff_separator(spark, path)
        reader = spark.read.option("header", True).option("sep", sep)
        if comment:
            reader = reader.option("comment", comment)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
        if keep_order:
            df = df.withColumn(ROW, row_order())
        first = df.columns[0]
        name = first.lstrip("﻿").strip('"')
        if name != first or first == "_c0":
            df = df.withColumnRenamed(first, "key" if name in ("", "_c0") else name)
        df = clean_text(df)
        if schema is None:
            df = infer_types(df)
    else:
        raise ValueError(f"cannot read files of type {suffix!r}")
    names = [drop_columns] if isinstance(drop_columns, str) else list(drop_columns)
    names = [n.strip() for n in names]
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise IndexError(f"columns to drop are not in the table: {missing}")
    return df.drop(*names)


def save_table(df: DataFrame, path: str, postfix: str = "", single_file: bool = False) -> str:
    """Write a folder of part files named after ``path``; ``.tsv`` is tab separated. Returns the folder."""
    target = PurePosixPath(path)
    folder = str(target.with_name(f"{target.stem}{postfix}{target.suffix}"))
    out = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    suffix = target.suffix.lower()
    if suffix == ".parquet":
        out.parquet(folder)
    else:
        out.option("header", True).option("sep", SEPARATORS.get(suffix, ",")).csv(folder)
    return folder


def write_id_list(df: DataFrame, key: str, path: str) -> None:
    """One ID per line."""
    df.select(F.col(key).cast("string")).filter(F.col(key).isNotNull()).distinct().write.mode("overwrite").text(path)


def _sample_pattern(suffix: str) -> str:
    """The name before ``suffix``, of a file or of a folder of part files."""
    return rf"([^/]+?){re.escape(suffix)}(?:/[^/]*)?$"


def _sample_names(df: DataFrame, pattern: str) -> list[str]:
    """Sample names taken from the file listing rather than from the data."""
    return sorted({re.search(pattern, unquote(p))[1] for p in df.inputFiles()})


def read_count_folder(spark: SparkSession, folder: str, input_format: str = ".txt", header: bool = True,
                      sep: str | None = None) -> DataFrame:
    """One count file per sample (key first, count last), or one folder of part files, joined by key into a matrix; samples sorted by name."""
    sep, pattern = sep or SEPARATORS.get(input_format) or "\t", _sample_pattern(input_format)
    raw = spark.read.option("header", header).option("sep", sep).csv(f"{folder}/*{input_format}")
    samples = _sample_names(raw, pattern)
    long = raw.select(F.trim(F.col(f"`{raw.columns[0]}`")).alias("key"),
                      F.col(f"`{raw.columns[-1]}`").cast("double").alias("n"),
                      F.regexp_extract(F.url_decode("_metadata.file_path"), pattern, 1).alias("sample"))
    return long.groupBy("key").pivot("sample", samples).agg(F.first("n", ignorenulls=True))


def read_htseq_folder(spark: SparkSession, folder: str, input_format: str = ".txt") -> tuple[DataFrame, DataFrame]:
    """Headerless two-column count files: (features, special counters)."""
    matrix = read_count_folder(spark, folder, input_format, header=False)
    special = F.col("key").isin(*SPECIAL_COUNTERS)
    return matrix.filter(~special), matrix.filter(special)


def read_abundance_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Per-sample ``<sample>/abundance.tsv`` files merged by transcript: (estimated counts, TPM)."""
    pattern = _sample_pattern("/abundance.tsv")
    raw = (spark.read.option("header", True).option("sep", "\t")
           .schema("target_id string, length long, eff_length double, est_counts double, tpm double").csv(f"{folder}/*/abundance.tsv"))
    samples = _sample_names(raw, pattern)
    long = raw.select("target_id", "est_counts", "tpm",
                      F.regexp_extract(F.url_decode("_metadata.file_path"), pattern, 1).alias("sample"))
    return tuple(long.groupBy("target_id").pivot("sample", samples).agg(F.first(c)) for c in ("est_counts", "tpm"))


def rename_count_output(counts: DataFrame, annotation: DataFrame, stats: DataFrame,
                        sample_names: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of an interval-counting run: name the sample columns and drop the index of the other two."""
    named = counts.toDF(counts.columns[0], *sample_names)
    return named, annotation.drop(annotation.columns[0]), stats.drop(stats.columns[0]).toDF(
        stats.columns[1], *sample_names)
