"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "keyloom") -> SparkSession:
    """A session for tests and local benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; fall back to a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="keyloom-checkpoint-")
    sc.setCheckpointDir(configured)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}/{name}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder that driver and executors share and continue from what was written.

    For tables of many rounds: unlike a checkpoint the copy has its true size, so small ones are joined without a shuffle, and brings nothing of what
    Catalyst inferred of its columns, which grows from round to round."""
    path = shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Give CPU-heavy row work enough tasks.

    Byte-based splits can leave very few partitions (a small file, one row group, coalesced shuffle output). Inputs that
    already have enough partitions are returned unchanged, so large scans are never shuffled for this.
    ``rows_per_task`` also bounds the rows of a task, at the price of counting them. Give a stored table: both look at its
    partitions, which would otherwise be computed for that alone.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows_per_task:
        wanted = max(wanted, -(-df.count() // rows_per_task))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
