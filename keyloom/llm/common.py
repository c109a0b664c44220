"""What the corpus operators share: stored tables, running sums and per-partition numpy work."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: White space of the contracts, as a character class and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACES.encode()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Names of the tables that this process has stored, oldest first.
_stored: list[str] = []


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from the written copy.

    Cuts the lineage and fixes rows (and stored partition numbers) for every later reader, so a lost executor cannot
    change them. Columnar and compressed, hence smaller than a checkpoint of rows.
    """
    spark = df.sparkSession
    _stored.append(f"keyloom-{uuid.uuid4().hex}")
    path = f"{shared_folder(spark)}/{_stored[-1]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_tables() -> list[str]:
    return list(_stored)


def drop_tables(spark: SparkSession, names: Sequence[str]) -> None:
    """Delete stored tables that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in names:
        at = path(f"{shared_folder(spark)}/{name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows: texts become Python objects one slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_count(text: Column) -> Column:
    """Runs of characters other than the contract's white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def running_sum(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], weights: dict[str, Column],
                partitions: int | None = None) -> DataFrame:
    """Add, for each ``name: weight``, the sum over the rows of the group up to and including this one as ``name``, and
    over the whole group as ``name__all``.

    Rows are range-partitioned on group and order, so one group may fill any number of tasks; a task adds the totals of the
    tasks before it from a table with a row per task and group. ``order`` should identify a row: rows that tie get
    sums in an arbitrary but stored order.
    """
    keys = [*[F.col(g) for g in groups], *[F.col(o) if isinstance(o, str) else o for o in order]]
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    chunks = store(dealt.sortWithinPartitions(*keys).withColumn("__chunk", F.spark_partition_id()))
    per_chunk = chunks.groupBy(*groups, "__chunk").agg(*[F.sum(w).alias(f"__{n}") for n, w in weights.items()])
    group = Window.partitionBy(*groups)
    before = group.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *[F.col(g).alias(f"__g_{g}") for g in groups], F.col("__chunk").alias("__c"),
        *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}_before") for n in weights],
        *[F.sum(f"__{n}").over(group).alias(f"{n}__all") for n in weights])
    local = Window.partitionBy("__chunk", *groups).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    summed = chunks.withColumns({f"__{n}_here": F.sum(w).over(local) for n, w in weights.items()})
    same = (F.col("__chunk") == F.col("__c"))
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return summed.join(offsets, same).select(
        *df.columns, *[(F.col(f"__{n}_here") + F.col(f"__{n}_before")).alias(n) for n in weights],
        *[f"{n}__all" for n in weights])
