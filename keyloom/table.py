"""Typed tables: a DataFrame with its key column and the operators that fit it.

The wrappers hold no data and never run a job by themselves; every method returns a new table or a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import aggregates, attributes, cluster, enrichment, filters, genome, mapping, models, normalize, pca, sets, sorting
from .sources import tables as files


class FeatureTable:
    """Any table with one row per feature."""

    def __init__(self, df: DataFrame, key: str | None = None, order: Sequence[str] = ()):
        self.key = key or df.columns[0]
        filters.require_columns(df, [self.key, *order])
        self.df, self.order = df, list(order)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, drop_columns: str | Sequence[str] = (), **options: Any):
        df = files.load_table(spark, path, drop_columns, keep_order=True)
        return cls(df, order=[files.ROW], **options)

    @classmethod
    def from_dataframe(cls, df: DataFrame, key: str | None = None, **options: Any):
        return cls(df, key, **options)

    def _new(self, df: DataFrame):
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__)
        out.df = df
        return out

    def _pair(self, parts: Sequence[DataFrame]):
        return tuple(self._new(p) for p in parts)

    # description
    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.key and c not in self.order]

    @property
    def samples(self) -> list[str]:
        return filters.numeric_columns(self.df, [self.key, *self.order])

    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.columns)

    def contains(self, value: Any) -> bool:
        return filters.contains_key(self.df, self.key, value)

    def equals(self, other: FeatureTable) -> bool:
        return filters.tables_equal(self.df, other.df)

    def has_unique_keys(self) -> bool:
        return filters.is_unique_key(self.df, self.key)

    def index_set(self) -> DataFrame:
        return sets.key_set(self.df, self.key)

    def index_string(self) -> DataFrame:
        return sets.to_text(self.df, self.key)

    def describe(self, percentiles: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
        return aggregates.describe(self.df.drop(*self.order), percentiles)

    def histogram(self, column: str, bins: int = 100) -> DataFrame:
        return aggregates.histogram(self.df, column, bins)

    def save_table(self, path: str, postfix: str = "", single_file: bool = False) -> str:
        return files.save_table(self.df.drop(*self.order), path, postfix, single_file)

    # filters
    def filter(self, predicate: Column, opposite: bool = False):
        return self._new(filters.keep(self.df, predicate, self.key, opposite))

    def number_filters(self, column: str, operator: str = "greater than", value: float = 0, opposite: bool = False):
        return self._new(filters.number_filters(self.df, self.key, column, operator, value, opposite))

    def text_filters(self, column: str, operator: str, value: str, literal: bool = False, opposite: bool = False):
        return self._new(filters.text_filters(self.df, self.key, column, operator, value, literal, opposite))

    def filter_missing_values(self, columns: str | Sequence[str] = "all", opposite: bool = False):
        return self._new(filters.filter_missing_values(self.df, self.key, columns, opposite))

    def filter_by_row_name(self, row_names: str | Sequence[str] | DataFrame, opposite: bool = False):
        return self._new(filters.filter_by_row_name(self.df, self.key, row_names, opposite))

    def filter_duplicate_ids(self, keep: str = "first", opposite: bool = False):
        return self._new(filters.filter_duplicate_ids(self.df, self.key, self._ordering(), keep, opposite))

    def drop_columns(self, columns: str | Sequence[str]):
        return self._new(filters.drop_columns(self.df, columns))

    def filter_percentile(self, percentile: float, column: str, interpolate: str = "linear", opposite: bool = False):
        return self._new(filters.filter_percentile(self.df, self.key, percentile, column, interpolate, opposite))

    def split_by_percentile(self, percentile: float, column: str, interpolate: str = "linear"):
        return self._pair(filters.split_by_percentile(self.df, self.key, percentile, column, interpolate))

    def filter_by_attribute(self, annotations: DataFrame, names: str | Sequence[str], mode: str = "union", opposite: bool = False):
        return self._new(attributes.filter_by_attribute(self.df, self.key, annotations, names, mode, opposite))

    def split_by_attribute(self, annotations: DataFrame, names: Sequence[str]) -> dict[str, FeatureTable]:
        tagged = attributes.split_by_attribute(self.df, self.key, annotations, names)
        return {n: self._new(tagged.filter(F.col("attribute") == n).drop("attribute")) for n in names}

    def filter_by_go_annotations(self, annotations: DataFrame, terms: str | Sequence[str], closure: DataFrame | None = None,
                                 mode: str = "union", opposite: bool = False):
        return self._new(attributes.filter_by_terms(self.df, self.key, annotations, terms, closure, mode, opposite))

    def filter_by_kegg_annotations(self, members: DataFrame, pathways: str | Sequence[str], mode: str = "union", opposite: bool = False):
        return self._new(attributes.filter_by_pathway(self.df, self.key, members, pathways, mode, opposite))

    def filter_biotype_from_ref_table(self, reference: DataFrame, biotype: str | Sequence[str] = "protein_coding", opposite: bool = False):
        key, column = reference.columns[:2]
        return self._new(attributes.filter_by_biotype(self.df, self.key, reference, biotype, key, column, opposite))

    def filter_biotype_from_gtf(self, annotation: DataFrame, biotype: str | Sequence[str] = "protein_coding",
                                attribute: str = "gene_biotype", feature: str = "gene", opposite: bool = False):
        ref = genome.biotype_map(annotation, self.df, self.key, attribute, feature)
        return self._new(attributes.filter_by_biotype(self.df, self.key, ref, biotype, self.key, "biotype", opposite))

    def biotypes_from_ref_table(self, reference: DataFrame, long_format: bool = False) -> DataFrame:
        key, column = reference.columns[:2]
        if long_format:
            return aggregates.biotypes_long(self.df, self.key, reference, key, column, self.samples)
        return aggregates.biotypes(self.df, self.key, reference, key, column)

    def biotypes_from_gtf(self, annotation: DataFrame, long_format: bool = False, attribute: str = "gene_biotype",
                          feature: str = "gene") -> DataFrame:
        return self.biotypes_from_ref_table(genome.biotype_map(annotation, self.df, self.key, attribute, feature), long_format)

    # order
    def _ordering(self) -> list[str]:
        if not self.order:
            raise ValueError("this table has no row order; load it from a file or name order columns")
        return self.order

    def sort(self, by: str | Sequence[str], ascending: bool | Sequence[bool] = True, na_position: str = "last"):
        return self._new(sorting.sort(self.df, by, ascending, na_position))

    def filter_top_n(self, by: str | Sequence[str], n: int = 100, ascending: bool | Sequence[bool] = True, na_position: str = "last",
                     opposite: bool = False):
        return self._new(sorting.filter_top_n(self.df, self.key, by, n, ascending, na_position, opposite))

    def head(self, n: int = 5) -> DataFrame:
        return sorting.head(self.df, self._ordering(), n)

    def tail(self, n: int = 5) -> DataFrame:
        return sorting.tail(self.df, self._ordering(), n)

    # columns
    def transform(self, function: str | Callable[[Column], Column], columns: str | Sequence[str] = "all"):
        names = self.samples if columns == "all" else [columns] if isinstance(columns, str) else list(columns)
        if isinstance(function, str) and function.lower() in ("box-cox", "standardize"):
            shape = scalar.box_cox if function.lower() == "box-cox" else scalar.standardize
            return self._new(shape(self.df, names))
        return self._new(scalar.transform_columns(self.df, names, function))

    # identifiers
    def translate_gene_ids(self, candidates: DataFrame, second: DataFrame | None = None, remove_unmapped: bool = False):
        return self._new(mapping.translate_ids(self.df, self.key, candidates, second, remove_unmapped))

    def map_orthologs(self, one_to_one: DataFrame, remove_unmapped: bool = False):
        """Apply a mapping made by one of the ortholog policies in ``operators.mapping``."""
        return self._new(mapping.apply_map(self.df, self.key, one_to_one, remove_unmapped))

    def find_paralogs(self, pairs: DataFrame, filter_percent_identity: bool = False) -> DataFrame:
        return mapping.paralogs(self.df, self.key, pairs, filter_percent_identity)

    # sets
    def _others(self, others: Sequence[Any]) -> list[DataFrame]:
        return [o.df if hasattr(o, "df") else o for o in others]

    def intersection(self, *others) -> DataFrame:
        return sets.intersection([self.df, *self._others(others)], self.key)

    def intersect_rows(self, *others):
        return self._new(sets.intersect_rows(self.df, self._others(others), self.key))

    def union(self, *others) -> DataFrame:
        return sets.union([self.df, *self._others(others)], self.key)

    def difference(self, *others) -> DataFrame:
        return sets.difference(self.df, self._others(others), self.key)

    def difference_rows(self, *others):
        return self._new(sets.difference_rows(self.df, self._others(others), self.key))

    def symmetric_difference(self, *others) -> DataFrame:
        return sets.symmetric_difference([self.df, *self._others(others)], self.key)

    def majority_vote_intersection(self, *others, majority_threshold: float = 0.5) -> DataFrame:
        return sets.majority_vote_intersection([self.df, *self._others(others)], self.key, majority_threshold)

    def concatenate(self, other: FeatureTable):
        return self._new(sets.concatenate(self.df, other.df, self.key))


class FoldChangeTable(FeatureTable):
    """One column of fold changes between two named conditions."""

    def __init__(self, df: DataFrame, key: str | None = None, order: Sequence[str] = (), numerator: str = "numerator",
                 denominator: str = "denominator"):
        super().__init__(df, key, order)
        self.numerator, self.denominator = numerator, denominator
        self.column = self.columns[0]

    def filter_abs_log2_fold_change(self, abslog2fc: float = 1, opposite: bool = False):
        return self._new(filters.filter_abs_log2_fold_change(self.df, self.key, abslog2fc, self.column, True, opposite))

    def filter_fold_change_direction(self, direction: str = "pos", opposite: bool = False):
        return self._new(filters.filter_fold_change_direction(self.df, self.key, direction, self.column, True, opposite))

    def split_fold_change_direction(self):
        return self._pair(filters.split_fold_change_direction(self.df, self.key, self.column, True))

    def randomization_test(self, ref: FoldChangeTable, alpha: float = 0.05, reps: int = 10000, random_seed: int = 0) -> DataFrame:
        return enrichment.fold_change_randomization(self.df, ref.df, self.key, self.column, alpha, reps, random_seed)


class DETable(FeatureTable):
    """Differential-expression results; the columns that play each role are named."""

    def __init__(self, df: DataFrame, key: str | None = None, order: Sequence[str] = (), log2fc: str = "log2FoldChange",
                 padj: str = "padj", pval: str = "pvalue"):
        super().__init__(df, key, order)
        self.log2fc, self.padj, self.pval = log2fc, padj, pval

    def filter_significant(self, alpha: float = 0.1, opposite: bool = False):
        return self._new(filters.filter_significant(self.df, self.key, alpha, self.padj, opposite))

    def filter_abs_log2_fold_change(self, abslog2fc: float = 1, opposite: bool = False):
        return self._new(filters.filter_abs_log2_fold_change(self.df, self.key, abslog2fc, self.log2fc, False, opposite))

    def filter_fold_change_direction(self, direction: str = "pos", opposite: bool = False):
        return self._new(filters.filter_fold_change_direction(self.df, self.key, direction, self.log2fc, False, opposite))

    def split_fold_change_direction(self):
        return self._pair(filters.split_fold_change_direction(self.df, self.key, self.log2fc))

    def volcano(self, alpha: float = 0.1, log2fc_threshold: float = 1) -> DataFrame:
        return filters.volcano(self.df, alpha, log2fc_threshold, self.log2fc, self.padj)

    def pval_histogram(self, adjusted: bool = False, bin_size: float = 0.05) -> DataFrame:
        return aggregates.pvalue_histogram(self.df, self.padj if adjusted else self.pval, bin_size)


class CountTable(FeatureTable):
    """Features x samples."""

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, input_format: str = ".txt") -> CountTable:
        return cls(files.read_count_folder(spark, folder, input_format))

    @classmethod
    def from_folder_htseqcount(cls, spark: SparkSession, folder: str, norm_to_rpm: bool = False, input_format: str = ".txt") -> CountTable:
        counted, special = files.read_htseq_folder(spark, folder, input_format)
        table = cls(counted)
        return table.normalize_to_rpm_htseqcount(special) if norm_to_rpm else table

    @property
    def triplicates(self) -> list[list[str]]:
        return aggregates.triplicates(self.samples)

    # filters
    def filter_low_reads(self, threshold: float = 5, n_samples: int = 1, opposite: bool = False):
        return self._new(filters.filter_low_reads(self.df, self.key, threshold, n_samples, self.samples, opposite))

    def split_by_reads(self, threshold: float = 5):
        return self._pair(filters.split_by_reads(self.df, self.key, threshold, self.samples))

    def filter_by_row_sum(self, threshold: float = 5, opposite: bool = False):
        return self._new(filters.filter_by_row_sum(self.df, self.key, threshold, self.samples, opposite))

    # summaries
    def average_replicate_samples(self, sample_grouping: Sequence[Sequence[str]], new_column_names: Sequence[str] | None = None,
                                  function: str = "mean") -> CountTable:
        return CountTable(aggregates.average_replicates(self.df, self.key, sample_grouping, new_column_names, function), self.key)

    def fold_change(self, numerator: Sequence[str], denominator: Sequence[str], numer_name: str = "numerator",
                    denom_name: str = "denominator") -> FoldChangeTable:
        df = aggregates.fold_change(self.df, self.key, numerator, denominator)
        return FoldChangeTable(df, self.key, numerator=numer_name, denominator=denom_name)

    def plot_expression(self, groups: Mapping[str, Sequence[str]], avg_function: str = "mean", spread_function: str = "sem") -> DataFrame:
        return aggregates.group_centre_spread(self.df, self.key, groups, avg_function, spread_function)

    def box_plot(self, groups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
        return aggregates.distribution_summary(self.df, self.samples, groups)

    def enhanced_box_plot(self, depth: int = 5) -> DataFrame:
        return aggregates.letter_values(self.df, self.samples, depth)

    def scatter_sample_vs_sample(self, sample1: Sequence[str], sample2: Sequence[str], highlight: DataFrame | None = None) -> DataFrame:
        return aggregates.sample_points(self.df, self.key, sample1, sample2, highlight)

    def pairplot(self, samples: Sequence[str] | None = None) -> DataFrame:
        return aggregates.spearman(self.df, self.key, samples or self.samples)

    def ma_plot(self, ref: str | int = "auto") -> DataFrame:
        return normalize.ma_table(self.df, self.key, self.samples, normalize.reference_sample(self.df, self.samples, ref))

    def clustergram(self, z_score: bool = False) -> DataFrame:
        return cluster.clustergram(self.df, self.key, self.samples, z_score)

    # normalisation
    def _scaled(self, factors: Mapping[str, float], return_scaling_factors: bool):
        out = self._new(normalize.divide(self.df, factors))
        return (out, normalize.factors_frame(self.df, factors)) if return_scaling_factors else out

    def normalize_to_rpm(self, return_scaling_factors: bool = False):
        return self._scaled(normalize.rpm_factors(self.df, self.samples), return_scaling_factors)

    def normalize_to_rpm_htseqcount(self, special_counters: DataFrame, return_scaling_factors: bool = False):
        return self._scaled(normalize.rpm_factors(self.df, self.samples, special_counters), return_scaling_factors)

    def normalize_to_rpkm(self, annotation: DataFrame, feature_type: str = "gene", method: str = "mean"):
        lengths = genome.feature_lengths(annotation, feature_type, method).withColumnRenamed("key", self.key)
        return self._new(normalize.normalize_to_rpkm(self.df, self.key, lengths, samples=self.samples))

    def normalize_to_tpm(self, annotation: DataFrame, feature_type: str = "gene", method: str = "mean"):
        lengths = genome.feature_lengths(annotation, feature_type, method).withColumnRenamed("key", self.key)
        return self._new(normalize.normalize_to_tpm(self.df, self.key, lengths, samples=self.samples))

    def normalize_to_quantile(self, quantile: float = 0.75, return_scaling_factors: bool = False):
        return self._scaled(normalize.quantile_factors(self.df, self.samples, quantile), return_scaling_factors)

    def normalize_tmm(self, log_ratio_trim: float = 0.3, sum_trim: float = 0.05, a_cutoff: float | None = -1e10,
                      ref_column: str | int = "auto", return_scaling_factors: bool = False):
        return self._scaled(normalize.tmm_factors(self.df, self.key, self.samples, log_ratio_trim, sum_trim, a_cutoff, ref_column),
                            return_scaling_factors)

    def normalize_rle(self, return_scaling_factors: bool = False):
        return self._scaled(normalize.rle_factors(self.df, self.samples), return_scaling_factors)

    def normalize_median_of_ratios(self, sample_grouping: Sequence[Sequence[str]], reference_group: int = 0,
                                   return_scaling_factors: bool = False):
        return self._scaled(normalize.median_of_ratios_factors(self.df, sample_grouping, reference_group), return_scaling_factors)

    def normalize_with_scaling_factors(self, factors: Mapping[str, float] | DataFrame):
        return self._new(normalize.normalize_with_scaling_factors(self.df, self.key, factors, self.samples))

    # clusters and components
    def _clusters(self, labels: DataFrame) -> FeatureTable:
        """The table with a ``cluster`` column; :meth:`parts` separates it."""
        return self._new(cluster.attach(self.df, self.key, labels))

    def parts(self, column: str = "cluster") -> dict[Any, FeatureTable]:
        """One table per value of a small label column."""
        values = [row[0] for row in self.df.select(column).distinct().orderBy(column).collect()]
        return {v: self._new(self.df.filter(F.col(column) == v).drop(column)) for v in values}

    def _features(self, power_transform: bool) -> DataFrame:
        return cluster.prepare(self.df, self.key, self.samples, power_transform)

    def _split_by_k(self, n_clusters: int | str | Sequence[int], fit: Callable, power_transform: bool, max_k: int | None, seed: int):
        """One table per K of ``fit(feats, key, k, seed=...)``; a criterion name (``gap`` or one of ``cluster.K_CRITERIA``) picks K first."""
        feats = self._features(power_transform)
        if isinstance(n_clusters, str):
            scored = (cluster.gap_statistic(self.df, self.key, self.samples, max_k, power_transform=power_transform, seed=seed, fit=fit)
                      if n_clusters == "gap" else cluster.score_k(feats, self.key, n_clusters, max_k, fit, seed=seed))
            n_clusters = scored.filter("best").first()["k"]
        several = [n_clusters] if isinstance(n_clusters, int) else list(n_clusters)
        out = [self._clusters(fit(feats, self.key, k, seed=seed)) for k in several]
        return out[0] if len(out) == 1 else tuple(out)

    def split_kmeans(self, n_clusters: int | str | Sequence[int], n_init: int = 3, max_iter: int = 300, random_seed: int = 0,
                     power_transform: bool = True, max_k: int | None = None):
        return self._split_by_k(n_clusters, partial(cluster.kmeans, n_init=n_init, max_iter=max_iter), power_transform, max_k, random_seed)

    def split_kmedoids(self, n_clusters: int | str | Sequence[int], n_init: int = 3, max_iter: int = 300, random_seed: int = 0,
                       metric: str = "euclidean", power_transform: bool = True, max_k: int | None = None):
        fit = partial(cluster.kmedoids, n_init=n_init, max_iter=max_iter, metric=metric)
        return self._split_by_k(n_clusters, fit, power_transform, max_k, random_seed)

    def split_hierarchical(self, n_clusters: int | str | Sequence[int] | None = None, distance_threshold: float | None = None,
                           metric: str = "euclidean", power_transform: bool = True, max_k: int | None = None, random_seed: int = 0, linkage: str = "bisecting"):
        """Bisection into K clusters, or exact single linkage in ``metric``: into K clusters or cut at a distance."""
        if distance_threshold is not None:
            return self._clusters(cluster.hierarchical(self._features(power_transform), self.key, n_clusters, distance_threshold, metric=metric))
        return self._split_by_k(n_clusters, partial(cluster.hierarchical, metric=metric, linkage=linkage), power_transform, max_k, random_seed)

    def split_hdbscan(self, min_cluster_size: int, min_samples: int = 1, metric: str = "euclidean", cluster_selection_epsilon: float = 0.0,
                      cluster_selection_method: str = "eom", power_transform: bool = True, return_probabilities: bool = False):
        return self._clusters(cluster.hdbscan(self._features(power_transform), self.key, min_cluster_size, min_samples, metric, cluster_selection_method,
                                              cluster_selection_epsilon, return_probabilities))

    def split_density(self, epsilon: float, min_samples: int = 1, min_cluster_size: int = 1, metric: str = "euclidean", power_transform: bool = True):
        """Clusters of rows linked within a radius."""
        return self._clusters(cluster.density_clusters(self._features(power_transform), self.key, epsilon, min_samples, min_cluster_size, metric))

    def split_clicom(self, *parameter_dicts: Mapping, replicate_grouping: Sequence[Sequence[str]] | None = None,
                     power_transform: Sequence[bool] = (True,), evidence_threshold: float = 2 / 3, cluster_unclustered_features: bool = False,
                     min_cluster_size: int = 15):
        setups = cluster.expand_setups(parameter_dicts, power_transform)
        solutions = cluster.run_setups(self.df, self.key, setups, replicate_grouping or [self.samples])
        return self._clusters(cluster.consensus(solutions, self.key, evidence_threshold, cluster_unclustered_features, min_cluster_size))

    def pca(self, samples: Sequence[str] | None = None, power_transform: bool = True) -> pca.PCA:
        return pca.PCA(self.df, self.key, samples or self.samples, power_transform)

    def sort_by_principal_component(self, component: int, ascending: bool = True, power_transform: bool = True):
        return self._new(pca.sort_by_principal_component(self.df, self.key, self.samples, component, ascending, power_transform))

    def split_by_principal_components(self, components: int | Sequence[int], gene_fraction: float = 0.1, power_transform: bool = True):
        wanted = [components] if isinstance(components, int) else list(components)
        tagged = pca.split_by_principal_components(self.df, self.key, self.samples, wanted, gene_fraction, power_transform)
        return {(c, side): self._new(tagged.filter((F.col("component") == c) & (F.col("side") == side)).drop("component", "side"))
                for c in wanted for side in ("top", "bottom")}

    # models
    def differential_expression_limma_voom(self, design: pd.DataFrame, comparisons: Sequence[tuple[str, str, str]], **options):
        return models.limma_voom(self.df, self.key, self.samples, design, comparisons, **options)

    def differential_expression_deseq2(self, design: pd.DataFrame, comparisons: Sequence[tuple[str, str, str]], **options) -> dict[str, DETable]:
        res = models.deseq2(self.df, self.key, self.samples, design, comparisons, **options)
        return {name: DETable(df, self.key) for name, df in res.items()}


class FeatureSet:
    """A set of feature IDs."""

    def __init__(self, df: DataFrame, key: str | None = None, name: str = "set"):
        self.key, self.name = key or df.columns[0], name
        self.df = sets.key_set(df, self.key)

    @classmethod
    def from_ids(cls, spark: SparkSession, ids: Sequence[Any], name: str = "set") -> FeatureSet:
        kind = "long" if ids and isinstance(next(iter(ids)), int) else "string"
        return cls(spark.createDataFrame([(i,) for i in ids], f"key {kind}"), "key", name)

    def _table(self) -> FeatureTable:
        return FeatureTable(self.df, self.key)

    def _set(self, df: DataFrame) -> FeatureSet:
        return FeatureSet(df, self.key, self.name)

    def _targets(self) -> DataFrame:
        return self.df.withColumn(enrichment.SET, F.lit(self.name))

    def save_txt(self, path: str) -> None:
        files.write_id_list(self.df, self.key, path)

    def union(self, *others) -> FeatureSet:
        return self._set(self._table().union(*others))

    def intersection(self, *others) -> FeatureSet:
        return self._set(self._table().intersection(*others))

    def difference(self, *others) -> FeatureSet:
        return self._set(self._table().difference(*others))

    def symmetric_difference(self, *others) -> FeatureSet:
        return self._set(self._table().symmetric_difference(*others))

    def majority_vote_intersection(self, *others, majority_threshold: float = 0.5) -> FeatureSet:
        return self._set(self._table().majority_vote_intersection(*others, majority_threshold=majority_threshold))

    def filter_by_attribute(self, annotations: DataFrame, names: str | Sequence[str], mode: str = "union", opposite: bool = False) -> FeatureSet:
        return self._set(self._table().filter_by_attribute(annotations, names, mode, opposite).df)

    def filter_biotype_from_ref_table(self, reference: DataFrame, biotype: str = "protein_coding", opposite: bool = False) -> FeatureSet:
        return self._set(self._table().filter_biotype_from_ref_table(reference, biotype, opposite).df)

    def filter_biotype_from_gtf(self, annotation: DataFrame, biotype: str = "protein_coding", **options) -> FeatureSet:
        return self._set(self._table().filter_biotype_from_gtf(annotation, biotype, **options).df)

    def filter_by_go_annotations(self, annotations: DataFrame, terms: str | Sequence[str], closure: DataFrame | None = None,
                                 mode: str = "union", opposite: bool = False) -> FeatureSet:
        return self._set(self._table().filter_by_go_annotations(annotations, terms, closure, mode, opposite).df)

    def filter_by_kegg_annotations(self, members: DataFrame, pathways: str | Sequence[str], mode: str = "union", opposite: bool = False) -> FeatureSet:
        return self._set(self._table().filter_by_kegg_annotations(members, pathways, mode, opposite).df)

    def translate_gene_ids(self, candidates: DataFrame, second: DataFrame | None = None, remove_unmapped: bool = False) -> FeatureSet:
        return self._set(self._table().translate_gene_ids(candidates, second, remove_unmapped).df)

    def map_orthologs(self, one_to_one: DataFrame, remove_unmapped: bool = False) -> FeatureSet:
        return self._set(self._table().map_orthologs(one_to_one, remove_unmapped).df)

    def find_paralogs(self, pairs: DataFrame, filter_percent_identity: bool = False) -> DataFrame:
        return self._table().find_paralogs(pairs, filter_percent_identity)

    def biotypes_from_ref_table(self, reference: DataFrame) -> DataFrame:
        return self._table().biotypes_from_ref_table(reference)

    def biotypes_from_gtf(self, annotation: DataFrame, **options) -> DataFrame:
        return self._table().biotypes_from_gtf(annotation, **options)

    def user_defined_enrichment(self, annotations: DataFrame, names: str | Sequence[str | int] = "all", **options) -> DataFrame:
        return enrichment.enrichment(attributes.select_attributes(annotations, names), self._targets(), self.key, **options)

    def non_categorical_enrichment(self, values: DataFrame, **options) -> DataFrame:
        return enrichment.numeric_enrichment(values, self._targets(), self.key, **options)

    def kegg_enrichment(self, members: DataFrame, names: DataFrame, **options) -> DataFrame:
        return enrichment.pathway_enrichment(members, names, self._targets(), self.key, **options)

    def go_enrichment(self, annotations: DataFrame, nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
        return enrichment.ontology_enrichment(annotations, self._targets(), self.key, nodes, edges, **options)


class RankedSet(FeatureSet):
    """Ordered unique IDs: (key, rank) with ranks from 0."""

    def __init__(self, df: DataFrame, key: str | None = None, rank: str = "rank", name: str = "ranked"):
        super().__init__(df, key, name)
        self.ranked = df.select(self.key, F.col(rank).alias("rank"))

    def check_unique(self) -> None:
        if not filters.is_unique_key(self.ranked, self.key):
            raise ValueError("a ranked set cannot repeat an ID")

    def single_set_enrichment(self, annotations: DataFrame, names: str | Sequence[str | int] = "all", **options) -> DataFrame:
        return enrichment.ranked_enrichment(attributes.select_attributes(annotations, names), self.ranked, self.key, **options)

    def single_set_kegg_enrichment(self, members: DataFrame, names: DataFrame, **options) -> DataFrame:
        options.setdefault("correction", "by")
        res = enrichment.ranked_enrichment(members.withColumnRenamed("pathway", "attribute"), self.ranked, self.key, **options)
        return res.join(names.select(F.col("pathway").alias("name"), F.col("name").alias("pathway_name")), "name", "left")

    def single_set_go_enrichment(self, annotations: DataFrame, closure: DataFrame | None = None, nodes: DataFrame | None = None,
                                 edges: DataFrame | None = None, **options) -> DataFrame:
        """With ``nodes`` and ``edges`` of the ontology, annotations are propagated by the option ``propagate`` (no, classic, elim)."""
        from .operators.ontology import propagate
        if nodes is not None and edges is not None:
            return enrichment.ranked_ontology_enrichment(annotations, self.ranked, self.key, nodes, edges, **options)
        rows = propagate(annotations, closure, self.key) if closure is not None else annotations
        options.setdefault("correction", "by")
        return enrichment.ranked_enrichment(rows.withColumnRenamed("term", "attribute"), self.ranked, self.key, **options)
