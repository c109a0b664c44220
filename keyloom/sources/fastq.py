"""FASTQ files as a Spark data source of byte ranges that find the next start of a record by themselves."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# File suffixes that count as reads.
FASTQ_SUFFIXES = (".fastq", ".fastq.gz", ".fq", ".fq.gz")
SPLIT_BYTES = 128 << 20
BATCH_RECORDS = 20_000
#: Tasks that small ranges are dealt to at least, if there are as many.
LEAST_TASKS = 64
FIELDS = pa.schema([(c, pa.string()) for c in ("sample", "read_id", "seq", "qual")])


@dataclass
class ByteRange(InputPartition):
    """The records that start at ``start`` or after, and before ``end``."""
    path: str
    sample: str | None
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Byte ranges that one task reads one after another."""
    ranges: list[ByteRange]


def dealt(ranges: list[ByteRange], least_tasks: int = LEAST_TASKS, task_bytes: int = SPLIT_BYTES) -> list[Ranges]:
    """Ranges in their order, dealt to tasks of about ``task_bytes`` bytes, or fewer where that makes less than ``least_tasks`` tasks."""
    room = min(task_bytes, -(-sum(r.end - r.start for r in ranges) // least_tasks))
    out: list[Ranges] = []
    held = 0
    for r in ranges:
        size = r.end - r.start
        if not out or held + size > room:
            out.append(Ranges([]))
            held = 0
        out[-1].ranges.append(r)
        held += size
    return out


def sample_of(path: str) -> str | None:
    """The ``sample=...`` folder that ``write_fastq`` makes, else the file's name without its suffixes."""
    folder = re.search(r"/sample=([^/]*)/[^/]*$", path)
    if folder:
        return None if folder[1] == "__HIVE_DEFAULT_PARTITION__" else unquote(folder[1])
    return path.rsplit("/", 1)[-1].split(".", 1)[0]


def holds_reads(path: str) -> bool:
    """Files with a suffix of reads, and the text files of ``write_fastq``."""
    return path.endswith(FASTQ_SUFFIXES) or ("/sample=" in path and path.endswith((".txt", ".txt.gz")))


def _text(line: bytes) -> bytes:
    return line.rstrip(b"\r\n")


def records(lines: Iterator[bytes], at: int, end: int) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(head, seq, qual) of the records whose head starts before ``end``; ``at`` is the place of the first line.

    A line is a head when it begins with @ and the next but one with +: quality that begins with @ is followed by a head and a
    sequence. Other lines before the first head are the rest of a record of the range before.
    """
    window: list[tuple[int, bytes]] = []

    def fill(n: int) -> bool:
        nonlocal at
        while len(window) < n:
            line = next(lines, b"")
            if not line:
                return False
            if window or _text(line):
                window.append((at, _text(line)))
            at += len(line)
        return True

    while fill(3):
        place, head = window[0]
        if place >= end:
            return
        if head.startswith(b"@") and window[2][1].startswith(b"+"):
            qual = window[3][1] if fill(4) else b""
            yield head, window[1][1], qual
            del window[:4]
        else:
            del window[0]


class FastqReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[InputPartition]:
        system, path = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(path)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        out: list[InputPartition] = []
        for f in sorted((f for f in files if f.is_file and holds_reads(f.path)), key=lambda f: f.path):
            step = f.size if f.path.endswith(".gz") else self.split_bytes
            out += [ByteRange(f.path, sample_of(f.path), s, min(s + step, f.size)) for s in range(0, f.size, max(step, 1))]
        return dealt(out) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for one in partition.ranges:
            yield from self._read(system, one)

    def _read(self, system: fs.FileSystem, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        with system.open_input_file(partition.path) as raw:
            if partition.path.endswith(".gz"):
                found = records(iter(gzip.GzipFile(fileobj=raw)), 0, 1 << 62)
            else:
                at = partition.start
                stream = io.BufferedReader(raw, 1 << 20)
                if at:
                    # a line that starts at ``start`` belongs to this range, one that is cut by it to the range before
                    stream.seek(at - 1)
                    at += len(stream.readline()) - 1
                found = records(iter(stream.readline, b""), at, partition.end)
            rows: list[tuple] = []
            for head, seq, qual in found:
                name = head[1:].split(maxsplit=1)[:1] if not head[1:2].isspace() else []
                rows.append((partition.sample, name[0].decode() if name else "", seq.decode(), qual.decode()))
                if len(rows) == BATCH_RECORDS:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], schema=FIELDS)


class FastqSource(DataSource):
    """Format ``fastq``: a file, or a folder with all its folders. Option ``split_bytes``: bytes of one range; gzip files are not split. Small ranges share a task."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "sample string, read_id string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def read_fastq(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(sample, read_id, seq, qual) of a file or folder of FASTQ files (gzip allowed), one sample for each file or ``sample=...`` folder.

    Byte ranges are read without a shuffle. Records have four lines; a file that ends within a record gives that one an empty quality when only
    that is missing and drops it otherwise. Line ends may be \\r\\n; empty lines between records are skipped.
    """
    spark.dataSource.register(FastqSource)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return spark.read.format("fastq").option("split_bytes", split_bytes).load(re.sub(r"^file:/+", "file:///", full))
