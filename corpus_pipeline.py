"""From documents to packed training contexts, in five stages that each call one operator of ``keyloom.llm``.

A stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of ``documents``. ``run`` writes
every stage as Parquet in the shared folder and reads it again for the next. Written results are what a stage goes back to after a
failure; the helper tables of a stage are dropped when the next begins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import langid, linededup, mixing, packing, simhash
from keyloom.llm.common import drop_tables, store, stored_tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Helper tables of the stage that ran last.
_helpers: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Drop the helpers of the stage before, if its result was written and ``docs`` reads nothing else; then note those of this stage."""
    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles()
        if files and not any(f"/{name}/" in file for name in _helpers for file in files):
            drop_tables(spark, _helpers)
            _helpers.clear()
        before = len(stored_tables())
        kept = work(spark, docs, sf_dir)
        _helpers.extend(stored_tables()[before:])
        return kept
    return run


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects; ``lang`` becomes the language found."""
    judged = langid.identify(docs)
    return judged.filter("accepted").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that repeat across documents, and documents of which no text is left by that."""
    kept = linededup.dedup_lines(docs)
    return _measured(kept.filter((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "")))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id. A group is connected by fingerprints up to three bits apart, and by
    texts that share 0.8 of their five-word shingles. Of rows that repeat a doc_id all stay or go; rows without one stay."""
    groups = simhash.similar_documents(docs).filter(F.col("doc_id").isNotNull())
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


@_stage
def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, also rows without a doc_id and rows that repeat one. A row is known by its file and its place there; a
    table that is not read from files is stored first."""
    rows = docs if _of_files(docs) else store(docs)
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    copies = mixing.mix_sources(rows, keep=["__file", "__row"]).select("__file", "__row", "copies").filter(F.col("copies") > 0)
    return rows.join(copies, ["__file", "__row"]).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


@_stage
def pack_contexts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of the training context."""
    return packing.pack(docs)


STAGES = [("language", identify_language), ("lines", drop_repeated_lines), ("near duplicates", drop_near_duplicates),
          ("mix", mix_to_targets), ("pack", pack_contexts)]
#: SQL has no Kneser-Ney models or XXH64 fingerprints; the stages are tested against brute-force versions.
ORACLE_SQL = None


def _of_files(docs: DataFrame) -> bool:
    """Whether the rows of ``docs`` still are those of files, and know where they stand."""
    try:
        return bool(docs.select("_metadata.row_index").schema)
    except AnalysisException:
        return False


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
