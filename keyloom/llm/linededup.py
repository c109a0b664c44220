"""Repeated-line removal behind two Bloom filters.

Every line leaves its document as a 64-bit hash only. Hashes are dealt to filter shards by value; a shard keeps one Bloom
filter of hashes seen and one of hashes seen again, and gives back the hashes of the second. Only lines with such a hash
(true repeats and the filters' false alarms) leave their documents as text; they are counted exactly, and the
documents that lose lines learn which. The filters never miss a repeat, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, in_slices, store

#: Hashes that one filter shard takes: it holds them (32 MB) next to its two filters (8 MB each).
SHARD_HASHES = 4_000_000
#: Bits of one filter: 16 for each hash, a power of two.
FILTER_BITS = 1 << 26


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of every line, as UTF-8: stripped, A-Z in lower case. None for a key of under ``min_chars`` code points."""
    keys = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip(SPACE_BYTES)
        long = len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "surrogatepass")) >= min_chars
        keys.append(key if long else None)
    return keys


def line_hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


class Bloom:
    """A Bloom filter of 64-bit hashes: two bits for each, cut from the hash itself."""

    def __init__(self, bits: int = FILTER_BITS):
        self.mask = np.uint64(bits - 1)
        self.bits = np.zeros(bits // 8, dtype=np.uint8)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.view(np.uint64)
        mixed = h * np.uint64(0x9E3779B97F4A7C15)
        return mixed >> np.uint64(5) & self.mask, (h ^ mixed >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20) & self.mask

    def add(self, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for at in self.places(hashes):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def repeated_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one shard: the distinct hashes that the second filter holds. ``again`` marks hashes met twice before they came here."""
    once, twice, kept = Bloom(), Bloom(), []
    for batch in batches:
        h = batch["h"].to_numpy()
        distinct, counts = np.unique(h, return_counts=True)
        seen = once.holds(distinct) | (counts > 1)
        twice.add(distinct[seen])
        twice.add(h[batch["again"].to_numpy()])
        once.add(distinct)
        kept.append(distinct)
    if kept:
        hashes = np.unique(np.concatenate(kept))
        yield pd.DataFrame({"h": hashes[twice.holds(hashes)]})


def _hashes_of(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids, hashes = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {line_hash(k) for k in line_keys(text, min_chars) if k is not None}
                hashes.extend(own)
                ids.extend([doc] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())], ["doc_id", "h"])
    return run


def _per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each hash once for a batch of lines: a line that fills the corpus sends one row from each batch."""
    for batch in batches:
        distinct, counts = np.unique(batch["h"].to_numpy(), return_counts=True)
        yield pd.DataFrame({"h": distinct, "again": counts > 1})


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines whose key is found in at least ``min_docs`` documents from all of them but the largest ``doc_id``.

    Lines are the parts between ``\\n``; a key is the line without white space (space, \\t, \\n, \\v, \\f, \\r) at its ends, A-Z
    in lower case, and counts only with at least ``min_chars`` code points. All lines of a document with a
    dropped key go. Returns the rows of ``docs`` with the new ``text``, and ``n_lines`` (before), ``n_dropped``; columns of
    ``docs`` with these two names are replaced. A null or empty text has one empty line and stays as it is. Rows with
    equal ``doc_id`` are one document for counting and keep or lose a line together; rows without ``doc_id`` are
    left alone and not counted. An empty table gives an empty result.
    """
    plain = docs.drop("n_lines", "n_dropped")
    hashed = store(plain.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
                   .mapInArrow(_hashes_of(min_chars), "doc_id long, h long"))
    shards = max(1, -(-hashed.count() // SHARD_HASHES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    suspects = (hashed.select("h").mapInPandas(_per_batch, "h long, again boolean").repartition(shards, "h")
                .mapInPandas(repeated_hashes, "h long"))
    doubted = hashed.join(suspects, "h").groupBy("doc_id").agg(F.collect_set("h").alias("__h"))

    @F.pandas_udf("array<binary>")
    def suspected(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, wanted):
            own = set(own.tolist())
            out.append(list({k for k in line_keys(text, min_chars) if k is not None and line_hash(k) in own}))
        return pd.Series(out)

    lines = plain.select(F.col("doc_id").cast("long"), "text").join(doubted, "doc_id").select(
        "doc_id", F.explode(suspected("text", "__h")).alias("key"))
    lines = store(lines.distinct())
    # stored, so that the join below has nothing to do but join and can split the rows of a hot line
    repeated = store(lines.groupBy("key").agg(F.count(F.lit(1)).alias("__n"), F.max("doc_id").alias("__keeper")).filter(
        F.col("__n") >= min_docs).select("key", "__keeper"))
    lost = lines.join(repeated, "key").filter(F.col("doc_id") != F.col("__keeper")).groupBy(
        F.col("doc_id").alias("__id")).agg(F.collect_list("key").alias("__lost"))

    @F.pandas_udf("text string, dropped long")
    def without(texts: pd.Series, lost_keys: pd.Series) -> pd.DataFrame:
        kept_texts, dropped = [], []
        for text, gone in zip(texts, lost_keys):
            if gone is None:
                kept_texts.append(None), dropped.append(0)
                continue
            gone, lines_here = set(gone), text.split("\n")
            kept = [line for line, key in zip(lines_here, line_keys(text, min_chars)) if key not in gone]
            kept_texts.append("\n".join(kept)), dropped.append(len(lines_here) - len(kept))
        return pd.DataFrame({"text": kept_texts, "dropped": dropped})

    cut = without(F.when(F.col("__lost").isNotNull(), F.col("text")), "__lost")
    joined = plain.join(lost, F.col("doc_id") == F.col("__id"), "left").withColumn("__cut", cut)
    text = F.when(F.col("__lost").isNotNull(), F.col("__cut.text")).otherwise(F.col("text"))
    return joined.withColumn("n_lines", F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)).cast("long") + 1).withColumn(
        "text", text).withColumn("n_dropped", F.col("__cut.dropped")).select(*plain.columns, "n_lines", "n_dropped")
