"""Training-order materialisation: token records at globally shuffled slots, in fixed-stride shards.

Every record of ``length`` token ids gets a running number, and a keyed Feistel permutation of the numbers gives its slot; numbers
outside the range walk the cycle until they are inside. Slots are cut into shards of equal length whose records have one stride,
so slot s is at byte (s % records) * stride of shard s // records, and a reader resumes anywhere without an index.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, running_sum, store

#: A record is doc_id (8 bytes), number of the record in its document (4), used ids (4), then the ids, 2 bytes each.
HEADER, HEADER_BYTES = "<qii", 16
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ROUNDS = 6
#: The tokenizer's pattern steps back through a run of white space one sign at a time, which ends its stack on very long ones.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level tokenizer of a rank file; the id after the last rank is free and marks the end of a document."""
    import tiktoken
    from public_tokenizers import PATTERN
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(enc, text: str) -> list[int]:
    """The ids of ``encode_ordinary`` for texts with white space of any length: the pattern takes a run less its last sign (the whole run
    at the end of the text) as one piece, so such a piece goes to the merges without the pattern."""
    ids, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += enc.encode_ordinary(text[at:run.start()])
        ids += enc._encode_single_piece(text[run.start():end])
        at = end
    return ids + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def round_keys(seed: int) -> list[int]:
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), seed & (1 << 64) - 1)
    return [int(k) for k in keys]


def permute(numbers: np.ndarray, total: int, seed: int) -> np.ndarray:
    """The slot of each number below ``total``: a bijection of range(total) that ``seed`` selects."""
    half = max(1, ((total - 1).bit_length() + 1) // 2)
    mask, bits, keys = np.uint64((1 << half) - 1), np.uint64(half), round_keys(seed)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & mask)
        return left << bits | right

    slots = step(numbers.astype(np.uint64))
    outside = np.flatnonzero(slots >= total)
    while len(outside):
        slots[outside] = step(slots[outside])
        outside = outside[slots[outside] >= total]
    return slots.astype(np.int64)


def token_records(docs: DataFrame, length: int, tokenizer: str) -> DataFrame:
    """(part, number, record): fixed-stride records of all documents in ranges of doc_id and text hash, numbered within the stored
    partition. Rows that agree in both have the same records, so the sequence of all records does not depend on how ``docs`` is split."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number = encoding(tokenizer), 0
        for batch in in_slices(batches):
            records = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*token_ids(enc, text or ""), enc.n_vocab], dtype="<u2")
                for n, at in enumerate(range(0, len(ids), length)):
                    part = ids[at:at + length]
                    body = part.tobytes()
                    records.append(struct.pack(HEADER, -1 if doc is None else doc, n, len(part)) + body + bytes(2 * length - len(body)))
            yield pa.RecordBatch.from_arrays([pa.array(range(number, number + len(records)), pa.int64()),
                                              pa.array(records, pa.binary())], ["number", "record"])
            number += len(records)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__hash"))
    order = ["doc_id", "__hash"]
    dealt = plain.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    return store(dealt.mapInArrow(run, "number long, record binary")
                 .withColumn("part", F.spark_partition_id()))


def training_order(docs: DataFrame, length: int = 512, records: int = 1024, seed: int = 42,
                   tokenizer: str = TOKENIZER) -> DataFrame:
    """Shards of all documents in a shuffled order: shard, first_slot, n_records, stride, payload.

    Each document is tokenized whole, ended with the free id and cut into records of ``length`` ids, the last one
    padded with zero bytes. ``payload`` is the records of slots first_slot to first_slot + n_records - 1 one after the
    other; all shards but the last have ``records``. Ids take two bytes, so the vocabulary must have fewer than 65,536. Null and empty texts give
    one record with the end id; a null doc_id is written as -1; rows that share a doc_id are written one by one. The slot of a
    record depends on its number in the order of doc_id and text hash, the number of records and ``seed``, not on how the rows are split. An empty table gives no shards.
    """
    tokens = token_records(docs, length, tokenizer)
    counts = tokens.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = store(running_sum(counts, [], ["part"], {"upto": F.col("n")}))
    total = offsets.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // records))
    tasks = min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // 64)))

    @F.pandas_udf("long")
    def slot_of(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, seed))

    stride = HEADER_BYTES + 2 * length
    placed = tokens.join(offsets.select("part", (F.col("upto") - F.col("n")).alias("__before")), "part").select(
        slot_of(F.col("number") + F.col("__before")).alias("slot"), "record")
    shard = F.floor(F.col("slot") / records)
    dealt = placed.repartitionById(tasks, F.floor(shard * tasks / shards).cast("int")).sortWithinPartitions("slot")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, first, parts, n = None, 0, [], 0

        def shut() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"shard": [open_shard], "first_slot": [first], "n_records": [n], "stride": [stride], "payload": [b"".join(parts)]}, schema=schema)

        schema = pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("n_records", pa.int64()), ("stride", pa.int64()),
                            ("payload", pa.binary())])
        for batch in batches:
            for slot, record in zip(batch.column(0).to_pylist(), batch.column(1)):
                if slot // records != open_shard:
                    if parts:
                        yield shut()
                    open_shard, first, parts, n = slot // records, slot, [], 0
                parts.append(record.as_py())
                n += 1
        if parts:
            yield shut()

    return dealt.mapInArrow(assemble, "shard long, first_slot long, n_records long, stride long, payload binary")


def read_slots(shards: DataFrame, start: int, stop: int) -> DataFrame:
    """(slot, doc_id, seq, ids) of the slots from ``start`` up to ``stop``: what a reader gets that resumes at ``start``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for s in batch.itertuples(index=False):
                for slot in range(max(start, s.first_slot), min(stop, s.first_slot + s.n_records)):
                    at = (slot - s.first_slot) * s.stride
                    doc, seq, used = struct.unpack_from(HEADER, s.payload, at)
                    rows.append((slot, doc, seq, np.frombuffer(s.payload, "<u2", used, at + HEADER_BYTES).astype(int).tolist()))
            yield pd.DataFrame(rows, columns=["slot", "doc_id", "seq", "ids"])
    wanted = (F.col("first_slot") < stop) & (F.col("first_slot") + F.col("n_records") > start)
    return shards.filter(wanted).mapInPandas(run, "slot long, doc_id long, seq long, ids array<int>")
