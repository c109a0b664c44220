"""Conflict-constrained best-fit packing of documents into training contexts.

A bin holds at most one piece of a source and at most one document of a duplicate cluster. Bins stand in order of their
residual and carry a bitmap of sources and one of clusters; the search starts at the smallest residual that fits and goes on
to the next until a compatible bin is found, else a bin is opened.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_CLASS, UPPER, running_sum, store, word_count

#: Documents that are packed together; a shard leaves a handful of badly filled bins at most.
SHARD_DOCS = 8192


class Bins:
    """Open bins by residual. ``levels`` has a bit for each residual that some bin has."""

    def __init__(self, capacity: int):
        self.capacity, self.levels, self.count = capacity, 0, 0
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = {}  # residual -> source bitmap -> (bin, cluster bitmap)

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put a piece into the tightest compatible bin; (bin, offset in it). ``source`` and ``cluster`` are bits, 0 for no conflict."""
        above = self.levels >> size
        while above:
            skip = (above & -above).bit_length() - 1
            residual = size + skip
            for sources, bins in self.at[residual].items():
                if sources & source:
                    continue
                for i, (number, clusters) in enumerate(bins):
                    if not clusters & cluster:
                        self.remove(residual, sources, i)
                        self.insert(residual - size, sources | source, number, clusters | cluster)
                        return number, self.capacity - residual
            above = (above >> (skip + 1)) << (skip + 1)
        number, self.count = self.count, self.count + 1
        self.insert(self.capacity - size, source, number, cluster)
        return number, 0

    def insert(self, residual: int, sources: int, number: int, clusters: int) -> None:
        self.at.setdefault(residual, {}).setdefault(sources, []).append((number, clusters))
        self.levels |= 1 << residual

    def remove(self, residual: int, sources: int, i: int) -> None:
        level = self.at[residual]
        bins = level[sources]
        bins[i] = bins[-1]
        bins.pop()
        if not bins:
            del level[sources]
            if not level:
                del self.at[residual]
                self.levels &= ~(1 << residual)


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best-fit decreasing over one shard, crowded sources first; a piece for each full capacity of a long document and one for its rest."""
    rows = rows.sort_values(["size", "doc_id", "uid"], ascending=[False, True, True], kind="stable")
    sources = pd.factorize(rows["source"], use_na_sentinel=False)[0]
    repeated = rows["cluster"].duplicated(keep=False).to_numpy()
    clusters = np.full(len(rows), -1)  # -1: no other document of its cluster is here
    clusters[repeated] = pd.factorize(rows["cluster"].to_numpy()[repeated])[0]
    bins, out, rest = Bins(capacity), [], []
    for row, source, cluster in zip(rows[["doc_id", "uid", "size"]].itertuples(index=False), sources, clusters):
        full, left = divmod(row[2], capacity)
        bit = 1 << int(cluster) if cluster >= 0 else 0
        for piece in range(full):
            number, bins.count = bins.count, bins.count + 1
            out.append((row[0], row[1], piece, piece * capacity, capacity, number, 0))
        if left or not full:
            rest.append((left, row[0], row[1], full, 1 << int(source), bit))
    # a source with many pieces needs as many bins: open those first, or its small pieces would find no bin left without it
    pieces, least = Counter(r[4] for r in rest), sum(r[0] for r in rest) / capacity
    rest.sort(key=lambda r: (-pieces[r[4]] if 2 * pieces[r[4]] > least else 0, -r[0]))
    for size, doc, uid, piece, source, cluster in rest:
        number, offset = bins.place(size, source, cluster)
        out.append((doc, uid, piece, piece * capacity, size, number, offset))
    return pd.DataFrame(out, columns=["doc_id", "uid", "piece", "first_word", "size", "bin", "offset"])


def pack(docs: DataFrame, capacity: int = 1024, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pack all ``docs`` into bins of ``capacity`` words.

    Returns a row per piece: doc_id, uid (number of the document's row in the order of doc_id, source, size and cluster), source, cluster, piece, first_word and size (the words of the
    document it holds), bin_id, offset (words before it in the bin). A document longer than the capacity fills bins of its own
    with whole pieces; its rest is packed like a short document. Documents whose words agree after lowering A-Z are one
    duplicate cluster. Documents without words are pieces of size 0. Null sources are one source; a null
    text counts as empty and a null doc_id stays null. Documents are dealt to shards of about ``shard_docs`` at random (by
    hash of doc_id and uid), so that a hot source or cluster is spread evenly and shards are packed in parallel. The result does not
    depend on how the rows are split or ordered. An empty table gives an empty result.
    """
    words = F.translate(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), f"[{SPACE_CLASS}]+", " ")), UPPER, LOWER)
    facts = ["doc_id", "source", "size", "cluster"]
    # rows that agree in all of these are alike to the packing; they are counted, and numbered after those before them
    alike = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                              word_count(F.col("text")).alias("size"), F.xxhash64(words).alias("cluster"))
                  .groupBy(*facts).agg(F.count(F.lit(1)).alias("__n")))
    sized = running_sum(alike, [], facts, {"__upto": F.col("__n")}).select(
        *facts, F.explode(F.sequence(F.col("__upto") - F.col("__n"), F.col("__upto") - 1)).alias("uid"),
        F.ceil(F.col("__upto__all") / shard_docs).alias("__shards"))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "uid"), F.col("__shards"))).drop("__shards")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packed = pack_shard(rows, capacity)
        packed["bin_id"] = int(key[0]) * (1 << 32) + packed["bin"]
        packed = packed.merge(rows[["uid", "source", "cluster"]], on="uid")
        packed["doc_id"] = packed["doc_id"].astype("Int64")
        return packed[["doc_id", "uid", "source", "cluster", "piece", "first_word", "size", "bin_id", "offset"]]

    return dealt.groupBy("shard").applyInPandas(
        run, "doc_id long, uid long, source string, cluster long, piece long, first_word long, size long, bin_id long, offset long")
