"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size gives the expected copies of each of its documents. The whole part is allocated for certain;
the rest is an inclusion probability p, met by ranking documents on Q = (u / (1 - u)) / (p / (1 - p)), u from a hash of the
document, and taking the smallest Q until the source's remaining words are spent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_sum, store, word_count

#: md5 digits that make a document's random number: 13 hex digits, all of a double's 52 bits.
DIGITS = 13


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 from the md5 of ``key``; equal keys give equal numbers on every engine."""
    digits = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return (digits + 0.5) / float(16 ** DIGITS)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources by code point, null last, weigh ``weights`` in turn; ``share`` times all sizes is dealt by weight. No target
    exceeds ``cap`` times its source's size; what is over goes to the others by weight, again until none is above. That
    fixed point is min(cap x size, level x weight) with one level for all, read off running sums in the order in which sources fill up.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.col("__n") - 1, F.lit(len(weights))).cast("int")
    ranked = running_sum(per_source.withColumn("__null", F.col("source").isNull()), [], ["__null", "source"], {"__n": F.lit(1)})
    weighed = ranked.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn(
        "__cap", F.col("source_size") * float(cap)).drop("__n", "__n__all")
    filled = running_sum(weighed, [], [F.col("__cap") / F.col("__w"), "__null", "source"],
                         {"__caps": F.col("__cap"), "__ws": F.col("__w"), "__sizes": F.col("source_size")})
    # if just the sources before this one were full, the rest would share the remainder at this level; the true level is the highest of these
    before_caps, left_w = F.col("__caps") - F.col("__cap"), F.col("__ws__all") - F.col("__ws") + F.col("__w")
    rows = store(filled.withColumn("__level", (F.col("__sizes__all") * float(share) - before_caps) / left_w))
    common = rows.agg(F.max("__level")).first()[0]  # one number
    return rows.select("source", "source_size", F.least("__cap", F.lit(common).cast("double") * F.col("__w")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
                seed: str = "mix", keep: Sequence[str] = ()) -> DataFrame:
    """How many copies of each document the mix takes.

    Returns per row of ``docs``: doc_id, size (words; null text 0), source, source_size, target, copies, taken (copies x size), and the
    columns ``keep`` of ``docs``, such as a row number to go back by.
    Within a source the sum of ``taken`` differs from the target by less than one document: of the two cuts around the target the nearer
    is taken, the lower on a tie. ``copies`` never exceeds ``cap`` rounded up. The random number depends on doc_id
    and ``seed`` alone, so reruns agree; rows that share a doc_id are ordered by text and stay separate rows. A null doc_id counts as
    the id "null". Sources without words have target 0 and copies of their empty documents at the whole part of the ratio 0.
    An empty table gives an empty result.
    """
    sized = store(docs.select(*keep, "doc_id", "source", word_count(F.col("text")).alias("size"),
                              F.xxhash64("text").alias("__tie")))
    targets = source_targets(sized, weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12)
    p = F.greatest(ratio - whole, F.lit(0.0))
    u = uniform(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    odds = F.when(p <= 1e-12, F.lit(float("inf"))).otherwise((u / (1 - u)) / (p / (1 - p)))
    few = targets.select(F.col("source").alias("__source"), "source_size", "target")
    ranked = sized.join(few, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumns(
        {"__whole": whole, "__odds": odds})
    summed = running_sum(ranked, ["source"], ["__odds", "doc_id", "__tie"], {"__upto": F.col("size")})
    rest = F.col("target") - F.col("__whole") * F.col("source_size")
    # a document is in if ending the sample with it is nearer to the target than ending just before it
    picked = (F.col("__upto") - F.col("size") / 2 < rest) & (F.col("__odds") < float("inf"))
    copies = (F.col("__whole") + picked.cast("long")).cast("long")
    return summed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"), *keep)
