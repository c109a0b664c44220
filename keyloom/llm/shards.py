"""Shards of a training order as files: ``shard-<number>.bin`` of fixed-stride records, a manifest, and readers that resume at any slot.

Files are reached through ``pyarrow.fs``, so the folder may be on any file system that it knows and that all executors share.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import HEADER, HEADER_BYTES

MANIFEST = "shard long, file string, first_slot long, n_records long, stride long, bytes long, sha256 string"
#: Records that are read from a file at once.
SLICE = 1024


def file_uri(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system, the default one of the session where it names none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub(r"^file:/+", "file:///", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/"))


def write_shards(shards: DataFrame, path: str) -> DataFrame:
    """Write each row of ``training_order`` as a file below ``path`` and return the manifest, stored as Parquet in ``path``/manifest.

    Tasks write under a name of their own and rename when all bytes are there, so a lost or doubled task leaves no half file under a final
    name. The manifest is written last and only in whole: a folder without one is an unfinished write, to be written again. A folder that has one is an error.
    An empty table gives an empty manifest and no files.
    """
    spark = shards.sparkSession
    folder = file_uri(spark, path)
    system, local = fs.FileSystem.from_uri(folder)
    if system.get_file_info(f"{local}/manifest/_SUCCESS").type != fs.FileType.NotFound:
        raise ValueError(f"{path} holds a finished training order")
    system.create_dir(local, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, local = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for s in batch.itertuples(index=False):
                name, mine = f"shard-{s.shard:010d}.bin", f"{local}/_{uuid.uuid4().hex}"
                with system.open_output_stream(mine) as out:
                    out.write(s.payload)
                system.move(mine, f"{local}/{name}")
                yield pd.DataFrame([(s.shard, name, s.first_slot, s.n_records, s.stride, len(s.payload), hashlib.sha256(s.payload).hexdigest())],
                                   columns=[c.split()[0] for c in MANIFEST.split(", ")])

    wanted = shards.select("shard", "first_slot", "n_records", "stride", "payload")
    wanted.mapInPandas(run, MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _records(system: fs.FileSystem, folder: str, s, start: int, stop: int) -> Iterator[tuple]:
    """(slot, doc_id, seq, ids) of one shard's slots from ``start`` up to ``stop``; only their bytes are read."""
    low, high = max(start, s.first_slot), min(stop, s.first_slot + s.n_records)
    if low >= high:
        return
    with system.open_input_file(f"{folder}/{s.file}") as data:
        if data.size() != s.bytes or s.bytes != s.n_records * s.stride:
            raise ValueError(f"{s.file} has {data.size()} bytes instead of {s.n_records * s.stride}")
        data.seek((low - s.first_slot) * s.stride)
        for first in range(low, high, SLICE):
            n = min(SLICE, high - first)
            piece = data.read(n * s.stride)
            for i in range(n):
                doc, seq, used = struct.unpack_from(HEADER, piece, i * s.stride)
                yield first + i, doc, seq, np.frombuffer(piece, "<u2", used, i * s.stride + HEADER_BYTES)


def read_files(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """(slot, doc_id, seq, ids) of the slots from ``start`` up to ``stop`` (all, if None), read by Spark from the files that hold them."""
    folder, end = file_uri(spark, path), (1 << 62) if stop is None else stop

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, local = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for s in batch.itertuples(index=False):
                rows: list[tuple] = []
                for slot, doc, seq, ids in _records(system, local, s, start, end):
                    rows.append((slot, doc, seq, ids.astype(int).tolist()))
                    if len(rows) == SLICE:
                        yield pd.DataFrame(rows, columns=["slot", "doc_id", "seq", "ids"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["slot", "doc_id", "seq", "ids"])

    wanted = read_manifest(spark, path).filter((F.col("first_slot") < end) & (F.col("first_slot") + F.col("n_records") > start))
    # a task takes one shard after the other; as many tasks as the session shuffles to
    return wanted.repartitionByRange("shard").mapInPandas(run, "slot long, doc_id long, seq long, ids array<int>")


def iterate(uri: str, start: int = 0) -> Iterator[tuple]:
    """(slot, doc_id, seq, ids) in training order from slot ``start``, for a trainer without Spark; a restart at slot s goes on as a full
    read does from there. ``uri`` is the folder as a URI or an absolute path."""
    system, local = fs.FileSystem.from_uri(uri)
    manifest = ds.dataset(f"{local}/manifest", filesystem=system, format="parquet").to_table(filter=ds.field("first_slot") + ds.field("n_records") > start)
    if not manifest.num_rows:
        return
    for s in manifest.to_pandas().sort_values("shard").itertuples(index=False):
        yield from _records(system, local, s, start, 1 << 62)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem) of the files that are missing or differ from the manifest's size or digest; none if all is well."""
    folder = file_uri(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, local = fs.FileSystem.from_uri(folder)
        for batch in batches:
            bad = []
            for s in batch.itertuples(index=False):
                info = system.get_file_info(f"{local}/{s.file}")
                if not info.is_file:
                    bad.append((s.file, "missing"))
                elif info.size != s.bytes:
                    bad.append((s.file, "size"))
                else:
                    digest = hashlib.sha256()
                    with system.open_input_stream(info.path) as data:
                        while piece := data.read(1 << 20):
                            digest.update(piece)
                    if digest.hexdigest() != s.sha256:
                        bad.append((s.file, "digest"))
            yield pd.DataFrame(bad, columns=["file", "problem"])

    return read_manifest(spark, path).repartitionByRange("shard").mapInPandas(run, "file string, problem string")
