"""Identifier translation and ortholog policies over mapping tables (from_id, to_id[, score])."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("first", "last", "random", "none")


def apply_map(df: DataFrame, key: str, mapping: DataFrame, remove_unmapped: bool = False) -> DataFrame:
    """Replace keys through a one-to-one mapping; unmapped keys stay or are dropped."""
    pairs = mapping.select(F.col("from_id").alias(key), F.col("to_id").alias("__to"))
    joined = df.join(pairs, key, "inner" if remove_unmapped else "left")
    return joined.select(*[F.coalesce("__to", F.col(key).cast(dict(pairs.dtypes)["__to"])).alias(key) if c == key else c
                           for c in df.columns])


def best_mapping(candidates: DataFrame, order: Sequence[str] = ("to_id",)) -> DataFrame:
    """One target per source: highest score, then smallest ``order``. Combines before the shuffle."""
    pick = F.min(F.struct((-F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("s"), *order, "to_id_"))
    return (candidates.withColumn("to_id_", F.col("to_id")).groupBy("from_id").agg(pick.alias("b"))
            .select("from_id", F.col("b.to_id_").alias("to_id")))


def two_hop(first: DataFrame, second: DataFrame) -> DataFrame:
    """Compose two mappings through their shared middle ID space."""
    a = first.select("from_id", F.col("to_id").alias("mid"))
    b = second.select(F.col("from_id").alias("mid"), "to_id")
    return a.join(b, "mid").select("from_id", "to_id")


def strip_version(ident: str | Column) -> Column:
    return F.regexp_replace(ident, r"\.\d+$", "")


def translate_ids(df: DataFrame, key: str, to_pivot: DataFrame, from_pivot: DataFrame | None = None,
                  remove_unmapped: bool = False, drop_versions: bool = False) -> DataFrame:
    """Translate keys through scored candidate tables, one hop or two."""
    mapping = best_mapping(to_pivot)
    if from_pivot is not None:
        mapping = two_hop(mapping, best_mapping(from_pivot))
    if drop_versions:
        mapping = mapping.withColumn("to_id", strip_version("to_id"))
    return apply_map(df, key, mapping, remove_unmapped)


def reverse_resolved(candidates: DataFrame, reverse: DataFrame) -> DataFrame:
    """Unique hits are kept; ambiguous sources take the target whose own best reverse score is highest.

    ``reverse`` is (from_id = target, to_id = pivot, score).
    """
    counted = candidates.groupBy("from_id").agg(F.count(F.lit(1)).alias("n"), F.min("to_id").alias("only"))
    scores = reverse.groupBy(F.col("from_id").alias("to_id")).agg(F.max("score").alias("score"))
    several = candidates.select("from_id", "to_id").join(counted.filter("n > 1").select("from_id"), "from_id", "left_semi").join(scores, "to_id")
    unique = counted.filter("n = 1").select("from_id", F.col("only").alias("to_id"))
    return unique.unionByName(best_mapping(several.select("from_id", "to_id", "score")))


def count_by_id_type(keys: DataFrame, key: str, tagged: DataFrame, by: Sequence[str] = ("id_type",)) -> DataFrame:
    """How many table keys each ID type (or species) knows. ``tagged`` is (id, *by)."""
    ids = keys.select(F.col(key).alias("id")).distinct()
    return tagged.select("id", *by).distinct().join(ids, "id", "left_semi").groupBy(*by).agg(
        F.count(F.lit(1)).alias("mapped"))


def best_id_type(keys: DataFrame, key: str, tagged: DataFrame, by: Sequence[str] = ("id_type",)) -> DataFrame:
    """The tag row with most mapped keys; names break ties."""
    return count_by_id_type(keys, key, tagged, by).orderBy(F.desc("mapped"), *by).limit(1)


# --- orthologs -----------------------------------------------------------------------------------------------------

def resolve(candidates: DataFrame, mode: str = "first", preference: Column | None = None, order: str = "order",
            seed: int = 0) -> DataFrame:
    """One-to-one mapping from ranked candidates (from_id, to_id, order).

    Only the best ``preference`` of a source competes; ties go by ``mode``: first or last by ``order``, random by a
    seeded md5, or ``none`` to leave the source unmapped. Two map-side combining aggregates, no window.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rank = F.lit(0.0) if preference is None else preference.cast("double")
    pair = F.struct(order, "to_id")
    shuffled = F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), "from_id", "to_id").cast("binary")).alias("h"), F.col("to_id"))
    chosen = {"first": F.min(pair), "last": F.max(pair), "random": F.min(shuffled), "none": F.min(pair)}[mode]
    levels = candidates.withColumn("__p", rank).groupBy("from_id", "__p").agg(
        F.count(F.lit(1)).alias("n"), chosen.alias("pick"))
    top = levels.groupBy("from_id").agg(F.max(F.struct("__p", "n", F.col("pick.to_id").alias("to_id"))).alias("t"))
    if mode == "none":
        top = top.filter("t.n = 1")
    return top.select("from_id", F.col("t.to_id").alias("to_id"))


def orthologs_by_divergence(candidates: DataFrame, filter_least_diverged: bool = True, mode: str = "first") -> DataFrame:
    """Prefer least-diverged pairs (``ortholog = 'LDO'``)."""
    preference = F.when(F.col("ortholog") == "LDO", 1).otherwise(0) if filter_least_diverged else None
    return resolve(candidates, mode, preference)


def orthologs_by_identity(candidates: DataFrame, filter_percent_identity: bool = True, mode: str = "first") -> DataFrame:
    """Keep the highest percent identity; without the filter take the first homology."""
    if not filter_percent_identity:
        return resolve(candidates, "first")
    return resolve(candidates, mode, F.col("perc_id"))


def orthologs_by_consistency(ids: DataFrame, key: str, to_protein: DataFrame, protein_pairs: DataFrame,
                             from_protein: DataFrame, threshold: float = 0.5, filter_consistency: bool = True,
                             mode: str = "first") -> tuple[DataFrame, DataFrame]:
    """External ID -> protein -> protein (score at least ``threshold``) -> external ID: (one-to-one, one-to-many)."""
    start = ids.select(F.col(key).alias("from_id")).distinct()
    a = to_protein.select(F.col("from_id"), F.col("to_id").alias("p1"))
    b = protein_pairs.filter(F.col("score") >= threshold).select(F.col("from_id").alias("p1"), F.col("to_id").alias("p2"), "score")
    c = from_protein.select(F.col("from_id").alias("p2"), "to_id")
    many = start.join(a, "from_id").join(b, "p1").join(c, "p2").select("from_id", "to_id", "score")
    ranked = many.withColumn("order", F.col("to_id"))
    one = resolve(ranked, mode, F.col("score") if filter_consistency else None)
    return one, many


def orthologs_from_groups(relations: DataFrame, mode: str = "first") -> tuple[DataFrame, DataFrame]:
    """(type, orthologs[], inparalogs[]) records: (one-to-one, one-to-many)."""
    kinds = F.lower("type")
    sources = F.when(kinds.startswith("one-to"), F.slice("inparalogs", 1, 1)).otherwise(F.col("inparalogs"))
    targets = F.when(kinds.endswith("to-one"), F.slice("orthologs", 1, 1)).otherwise(F.col("orthologs"))
    many = relations.select(F.explode(sources).alias("from_id"), targets.alias("targets")).select(
        "from_id", F.posexplode("targets").alias("order", "to_id"))
    return resolve(many, mode), many.select("from_id", "to_id")


def one_to_many(candidates: DataFrame, from_name: str = "gene", to_name: str = "ortholog") -> DataFrame:
    return candidates.select(F.col("from_id").alias(from_name), F.col("to_id").alias(to_name)).distinct()


def explode_lists(table: DataFrame, key: str, lists: str, to_name: str) -> DataFrame:
    """Lists of targets to one row per pair."""
    return table.select(key, F.explode(lists).alias(to_name))


def paralogs(ids: DataFrame, key: str, pairs: DataFrame, filter_percent_identity: bool = False) -> DataFrame:
    """(gene, paralog) pairs of the table's genes; with the filter only the closest paralog of each gene."""
    found = pairs.join(ids.select(F.col(key).alias("from_id")).distinct(), "from_id", "left_semi")
    if filter_percent_identity:
        found = resolve(found.withColumn("order", F.col("to_id")), "first", F.col("perc_id"))
    return one_to_many(found, "gene", "paralog")


def back_translate(results: DataFrame, translated: DataFrame) -> DataFrame:
    """Relate results on translated IDs to the original IDs (``translated`` is original from_id -> to_id)."""
    originals = translated.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("__original"))
    rest = [c for c in results.columns if c != "from_id"]
    return results.join(originals, "from_id").select(F.col("__original").alias("from_id"), *rest)
