"""What genome annotation says about features: names, biotypes, lengths, transcript sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import column_sums
from .ranking import quantiles

# name / version / split settings in the order in which they are tried
KEY_VARIANTS = [(n, v, s) for n in (False, True) for v in (True, False) for s in (True, False)]


def _identifier(attrs: Column, feature: str, use_version: bool, split_ids: bool) -> Column:
    ident = attrs[f"{feature}_id"]
    if split_ids:
        ident = F.substring_index(ident, ".", 1)
    if use_version:
        version = attrs[f"{feature}_version"]
        ident = F.when(version.isNotNull(), F.concat(ident, F.lit("."), version)).otherwise(ident)
    return ident


def _name(attrs: Column, feature: str) -> Column:
    return F.coalesce(attrs[f"{feature}_name"], attrs["name"])


def _key(attrs: Column, feature: str, variant: tuple[bool, bool, bool]) -> Column:
    use_name, use_version, split_ids = variant
    return _name(attrs, feature) if use_name else _identifier(attrs, feature, use_version, split_ids)


def _first(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """First value per key by row order, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.min(F.struct(order, value)).alias("__v")).select(*keys, F.col(f"__v.{value}").alias(value))


def gene_attribute_map(annotation: DataFrame, attribute: str, feature: str = "gene", use_name: bool = False,
                       use_version: bool = False, split_ids: bool = False, order: str = "_row") -> DataFrame:
    """(key, value): the first value of an attribute per gene or transcript."""
    attrs = F.col("attrs")
    rows = annotation.select(_key(attrs, feature, (use_name, use_version, split_ids)).alias("key"),
                             attrs[attribute].alias("value"), order)
    return _first(rows.filter("key is not null and value is not null"), ["key"], "value", order)


def transcripts_to_genes(annotation: DataFrame, use_name: bool = False, use_version: bool = True,
                         split_ids: bool = True, order: str = "_row") -> DataFrame:
    """(transcript, gene) from transcript lines; the first line of a transcript wins."""
    attrs = F.col("attrs")
    versioned = F.lit(use_version) & attrs["transcript_version"].isNotNull() & attrs["gene_version"].isNotNull()

    def ident(feature: str) -> Column:
        return F.when(versioned, _identifier(attrs, feature, True, split_ids)).otherwise(_identifier(attrs, feature, False, split_ids))

    gene = attrs["gene_name"] if use_name else ident("gene")
    rows = annotation.filter("feature = 'transcript'").select(ident("transcript").alias("transcript"), gene.alias("gene"), order)
    return _first(rows.filter("transcript is not null and gene is not null"), ["transcript"], "gene", order)


def best_key_variant(annotation: DataFrame, keys: DataFrame, key: str, feature: str = "gene") -> tuple[bool, bool, bool]:
    """The first of the eight key spellings that meets any key of the table; all are tried in one pass."""
    attrs = F.col("attrs")
    candidates = annotation.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("variant"), _key(attrs, feature, v).cast("string").alias("k"))
        for i, v in enumerate(KEY_VARIANTS)]))).filter("k is not null").distinct()
    wanted = keys.select(F.col(key).cast("string").alias("k")).distinct()
    hit = candidates.join(wanted, "k", "left_semi").agg(F.min("variant").alias("variant")).first()["variant"]
    if hit is None:
        raise ValueError("no spelling of the annotation's identifiers occurs in the table")
    return KEY_VARIANTS[hit]


def biotype_map(annotation: DataFrame, keys: DataFrame, key: str, attribute: str = "gene_biotype",
                feature: str = "gene") -> DataFrame:
    """(key, biotype) in the spelling the table uses."""
    tagged = annotation.filter(F.col("attrs")[attribute].isNotNull())
    use_name, use_version, split_ids = best_key_variant(tagged, keys, key, feature)
    found = gene_attribute_map(tagged, attribute, feature, use_name, use_version, split_ids)
    return found.select(F.col("key").alias(key), F.col("value").alias("biotype"))


# --- lengths --------------------------------------------------------------------------------------------------

def union_lengths(intervals: DataFrame, groups: Sequence[str], start: str = "start", end: str = "end",
                  tile: int = 4096, name: str = "length") -> DataFrame:
    """Length of the union of inclusive integer intervals per group.

    Intervals are cut at multiples of ``tile`` so that every tile is solved on its own and lengths just add up. After
    keeping the furthest end per start a tile has at most ``tile`` rows, however many intervals a group holds.
    """
    first, last = F.floor(F.col(start) / tile), F.floor(F.col(end) / tile)
    pieces = (intervals.filter(F.col(end) >= F.col(start))
              .select(*groups, F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e"),
                      F.explode(F.sequence(first, last)).alias("__tile"))
              .select(*groups, "__tile", F.greatest("__s", F.col("__tile") * tile).alias("__s"),
                      F.least("__e", F.col("__tile") * tile + tile - 1).alias("__e"))
              .groupBy(*groups, "__tile", "__s").agg(F.max("__e").alias("__e")))
    before = Window.partitionBy(*groups, "__tile").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("__e").over(before), F.col("__s") - 1)
    added = F.greatest(F.lit(0), F.col("__e") - F.greatest(F.col("__s") - 1, reached))
    return pieces.withColumn("__n", added).groupBy(*groups).agg(F.sum("__n").alias(name))


_LENGTH_METHODS = {
    "mean": lambda x: F.avg(x), "max": lambda x: F.max(x), "min": lambda x: F.min(x),
    "median": None, "geometric_mean": lambda x: F.exp(F.avg(F.ln(x))),
}


def feature_lengths(annotation: DataFrame, feature: str = "gene", method: str = "mean") -> DataFrame:
    """(key, length): exon lengths summed per transcript, then one statistic per gene; or merged exons per gene."""
    if method != "merged_exons" and method not in _LENGTH_METHODS:
        raise ValueError(f"unknown method {method!r}")
    is_list = dict(annotation.dtypes)["attrs"].endswith("array<string>>")
    attrs = F.col("attrs")
    if is_list:
        parents, ident, gene = attrs["Parent"], F.get(attrs["ID"], F.lit(0)), F.get(attrs["Parent"], F.lit(0))
    else:
        parents, ident, gene = F.array(attrs["transcript_id"]), attrs["transcript_id"], attrs["gene_id"]
    models = annotation.filter(F.col("feature").isin("transcript", "mRNA")).select(
        ident.alias("transcript"), gene.alias("key")).filter("transcript is not null").distinct()
    exons = annotation.filter("feature = 'exon'").select(
        F.explode(parents).alias("transcript"), "start", "end", (F.col("end") - F.col("start") + 1).alias("n"))
    if feature == "gene" and method == "merged_exons":
        return union_lengths(exons.join(models, "transcript").select("key", "start", "end"), ["key"])
    per_transcript = exons.groupBy("transcript").agg(F.sum("n").alias("length"))
    if feature == "transcript":
        return per_transcript.withColumnRenamed("transcript", "key")
    by_gene = per_transcript.join(models, "transcript")
    if method == "median":
        return quantiles(by_gene, "length", {"length": 0.5}, ["key"])
    return by_gene.groupBy("key").agg(
        _LENGTH_METHODS[method](F.col("length")).cast("double").alias("length"))


# --- transcript sums ----------------------------------------------------------------------------------------------

def sum_transcripts_to_genes(counts: DataFrame, tpm: DataFrame, mapping: DataFrame, key: str,
                             samples: Sequence[str], method: str = "scaled_tpm") -> DataFrame:
    """Gene-level counts: plain sums of counts, or summed TPM scaled by the library size in millions."""
    if method not in ("raw", "scaled_tpm"):
        raise ValueError("method must be raw or scaled_tpm")
    pairs = mapping.select(F.col("transcript").alias(key), "gene")
    source = counts if method == "raw" else tpm
    sums = source.join(pairs, key).groupBy("gene").agg(*[F.sum(c).alias(c) for c in samples])
    if method == "raw":
        return sums
    sizes = column_sums(counts, samples)
    return sums.withColumns({c: F.col(c) * F.lit(sizes[c] / 1e6) for c in samples})
