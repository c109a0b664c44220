"""Clustering of features (rows) by their sample profile.

Every method returns ``(key, cluster)`` with clusters numbered from 0 by decreasing size and -1 for unclustered rows.
Cluster centres, medoids and per-cluster sums are k-sized and travel as literals; rows never meet pairwise.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, distance, scalar
from ..session import checkpoint
from . import linkage as trees
from .filters import numeric_columns
from .graphs import connected_components
from .neighbours import core_rows, distance_sums, neighbour_links
from .ranking import row_numbers
from .skew import lookup

UNCLUSTERED = -1


def prepare(df: DataFrame, key: str, samples: Sequence[str] | None = None, power_transform: bool = True) -> DataFrame:
    """(key, features): Box-Cox and z-score, or z-score alone, per sample column; stored once."""
    samples = list(samples or numeric_columns(df, [key]))
    narrow = df.select(key, *samples)
    shaped = scalar.box_cox(narrow, samples) if power_transform else scalar.standardize(narrow, samples)
    return checkpoint(shaped.select(key, F.array(*[F.col(c).cast("double") for c in samples]).alias("features")))


def number_clusters(labels: DataFrame, key: str, min_size: int = 1) -> DataFrame:
    """Number the groups of ``cluster`` (any type) from 0 by decreasing size, the larger old label first on ties. Rows without a group
    and rows of groups under ``min_size`` get -1. The numbers are distributed row numbers: there may be as many groups as rows."""
    sizes = labels.filter(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
    order = row_numbers(sizes, [], [F.desc("n"), F.desc("cluster")], "__new").select("cluster", (F.col("__new") - 1).cast("int").alias("__new"))
    return labels.join(order, "cluster", "left").select(key, F.coalesce("__new", F.lit(UNCLUSTERED)).alias("cluster"))


def sort_clusters(labels: DataFrame, key: str) -> DataFrame:
    """Renumber clusters by decreasing size; the larger old label first on ties. -1 stays -1."""
    return number_clusters(labels.withColumn("cluster", F.when(F.col("cluster") != UNCLUSTERED, F.col("cluster"))), key)


def attach(df: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """The table with its cluster numbers; filter on ``cluster`` to get one part."""
    return df.join(labels, key)


# --- k-means and bisecting k-means ------------------------------------------------------------------------------------

def _fit_kmeans(feats: DataFrame, k: int, n_init: int, max_iter: int, seed: int):
    """The best of ``n_init`` runs by training cost."""
    data = feats.withColumn("v", array_to_vector("features"))
    models = [KMeans(k=k, maxIter=max_iter, seed=seed + i, featuresCol="v", predictionCol="cluster").fit(data)
              for i in range(n_init)]
    return min(models, key=lambda m: m.summary.trainingCost), data


def kmeans(feats: DataFrame, key: str, n_clusters: int, n_init: int = 3, max_iter: int = 300, seed: int = 0) -> DataFrame:
    if n_clusters == 1:
        return feats.select(key, F.lit(0).alias("cluster"))
    model, data = _fit_kmeans(feats, n_clusters, n_init, max_iter, seed)
    return sort_clusters(model.transform(data).select(key, "cluster"), key)


def hierarchical(feats: DataFrame, key: str, n_clusters: int | None = None, distance_threshold: float | None = None,
                 max_iter: int = 50, seed: int = 0, metric: str = "euclidean", linkage: str = "bisecting") -> DataFrame:
    """Top-down bisection into K clusters (Euclidean), or exact single linkage in any metric, into K clusters or cut at a distance."""
    if (n_clusters is None) == (distance_threshold is None):
        raise ValueError("give either n_clusters or distance_threshold")
    if linkage not in ("bisecting", "single"):
        raise ValueError("linkage is bisecting or single")
    if distance_threshold is not None:
        return density_clusters(feats, key, distance_threshold, min_samples=1, min_cluster_size=1, metric=metric)
    if linkage == "single":
        points = _points(feats, key)
        groups = trees.cut_into(points, trees.minimum_spanning_tree(points, metric), n_clusters)
        return number_clusters(groups.select(F.col("node").alias(key), F.col("component").alias("cluster")), key)
    if metric not in ("euclidean", "l2"):
        raise ValueError("bisection into n_clusters is Euclidean")
    # the first split moves the mean by a share of its length, so standardised data must not have it at zero
    data = feats.withColumn("v", array_to_vector(F.transform("features", lambda x: x + 10.0)))
    model = BisectingKMeans(k=n_clusters, maxIter=max_iter, seed=seed, featuresCol="v", predictionCol="cluster").fit(data)
    return sort_clusters(model.transform(data).select(key, "cluster"), key)


def _points(feats: DataFrame, key: str) -> DataFrame:
    return checkpoint(feats.select(F.col(key).alias("node"), F.col("features").alias("p")))


def dendrogram(feats: DataFrame, key: str, metric: str = "euclidean") -> DataFrame:
    """Single linkage as a table of merges, lightest first: merge, distance, the nearest rows of the two sides, what each side is (the number of an
    earlier merge, or null for that single row) and its size."""
    joined = trees.merges(trees.minimum_spanning_tree(_points(feats, key), metric))
    return joined.select("merge", F.col("w").alias("distance"), F.col("a").alias("left_row"), F.col("b").alias("right_row"), "left", "right", "left_size", "right_size")


def hdbscan(feats: DataFrame, key: str, min_cluster_size: int = 5, min_samples: int = 1, metric: str = "euclidean", cluster_selection_method: str = "eom",
            cluster_selection_epsilon: float = 0.0, probabilities: bool = False, seed: int | None = None) -> DataFrame:
    """Clusters that persist in the hierarchy of densities, found without a radius; rows of none are -1. With ``probabilities`` also the strength with
    which each row belongs to its cluster, 0 outside. ``min_samples`` counts other rows. Nothing is drawn, so ``seed`` is not used."""
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size is at least 2")
    found = checkpoint(trees.density_hierarchy(_points(feats, key), metric, min_cluster_size, min_samples, cluster_selection_method, cluster_selection_epsilon))
    labels = number_clusters(found.select(F.col("node").alias(key), "cluster"), key)
    return labels.join(found.select(F.col("node").alias(key), "probability"), key) if probabilities else labels


# --- k-medoids -----------------------------------------------------------------------------------------------------------

def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()) if len(series) else np.empty((0, 0))


def _assign(feats: DataFrame, key: str, points: np.ndarray, metric: str) -> DataFrame:
    kind = feats.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distance.distances(_matrix(pdf["features"]), points, metric)
                yield pdf.assign(cluster=d.argmin(1).astype("int32"), dist=d.min(1))

    return feats.mapInPandas(run, f"{key} {kind}, features array<double>, cluster int, dist double")


def medoids_of(assigned: DataFrame, key: str, metric: str) -> DataFrame:
    """(cluster, gene key, features, cost): of each cluster the member with the lowest total distance to all members; the smaller key on
    ties. Members meet chunk by chunk, and only their sums leave a task."""
    points = assigned.select(F.col(key).alias("node"), F.col("features").alias("p"), F.col("cluster").cast("string").alias("box"))
    costs = distance_sums(points, metric)
    members = assigned.select(key, "cluster", "features").join(costs.withColumnRenamed("node", key), key)
    return members.groupBy("cluster").agg(F.min(F.struct("cost", key, "features")).alias("m")).select("cluster", f"m.{key}", "m.features", "m.cost")


def fit_kmedoids(feats: DataFrame, key: str, n_clusters: int, n_init: int = 3, max_iter: int = 300, metric: str = "euclidean",
                 seed: int = 0) -> np.ndarray:
    """Medoids of the start with the lowest total distance. A start takes the rows nearest to seeded k-means centres, then alternates between
    assigning all rows to their nearest medoid and re-choosing each medoid among all members, until the total stops falling."""
    best: tuple[float, np.ndarray] | None = None
    for i in range(n_init):
        model, _ = _fit_kmeans(feats, n_clusters, 1, 5, seed + i)
        near = checkpoint(_assign(feats, key, np.array(model.clusterCenters()), metric))
        first = near.groupBy("cluster").agg(F.min(F.struct("dist", key, "features")).alias("m")).orderBy("cluster").collect()
        medoids, cost = np.array([r["m"]["features"] for r in first]), math.inf
        for _ in range(max_iter):
            assigned = checkpoint(_assign(feats, key, medoids, metric))
            total = assigned.agg(F.sum("dist")).first()[0]
            if total >= cost * (1 - 1e-12):
                break
            cost, kept = total, medoids
            medoids = np.array([r["features"] for r in medoids_of(assigned, key, metric).orderBy("cluster").collect()])
        if best is None or cost < best[0]:
            best = (cost, kept)
    return best[1]


def kmedoids(feats: DataFrame, key: str, n_clusters: int, n_init: int = 3, max_iter: int = 300, metric: str = "euclidean",
             seed: int = 0) -> DataFrame:
    """Labels by nearest medoid. Re-choosing medoids measures all members of a cluster against each other, in chunks."""
    medoids = fit_kmedoids(feats, key, n_clusters, n_init, max_iter, metric, seed)
    return sort_clusters(_assign(feats, key, medoids, metric).select(key, "cluster"), key)


# --- density clusters -------------------------------------------------------------------------------------------------------

def density_clusters(feats: DataFrame, key: str, eps: float, min_samples: int = 1, min_cluster_size: int = 5,
                     metric: str = "euclidean") -> DataFrame:
    """Clusters of core points linked within ``eps``; everything else, and clusters of fewer than ``min_cluster_size`` rows, is -1.

    A core point has at least ``min_samples`` rows within ``eps``, itself included. Every distance is measured between rows; with metrics
    that a grid bounds only rows of neighbouring boxes are compared. Links are a spanning set, not pairs.
    """
    points = checkpoint(feats.select(F.col(key).alias("node"), F.col("features").alias("p")))
    core = points
    if min_samples > 1:
        dense = core_rows(points, eps, min_samples, metric)
        core = checkpoint(points.join(dense, "node", "left_semi"))
    groups = connected_components(core.select("node"), neighbour_links(core, eps, metric))
    labelled = points.join(groups, "node", "left").select(F.col("node").alias(key), F.col("component").alias("cluster"))
    return number_clusters(labelled, key, min_cluster_size)


# --- number of clusters -----------------------------------------------------------------------------------------------------

def _cluster_sums(feats: DataFrame, labels: DataFrame, key: str) -> tuple[list[dict], np.ndarray, int]:
    """Per cluster: size, mean and total squared distance to the mean. k-sized."""
    joined = feats.join(labels, key).withColumn("v", array_to_vector("features"))
    rows = joined.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("v")).alias("m"), Summarizer.variance(F.col("v")).alias("var"),
    ).collect()
    out = [{"n": r["n"], "m": np.array(r["m"]), "ss": float(np.sum(r["var"]) * (r["n"] - 1)), "cluster": r["cluster"]} for r in rows]
    total = sum(r["n"] for r in out)
    centre = sum(r["n"] * r["m"] for r in out) / total
    return out, centre, total


def calinski_harabasz(feats: DataFrame, labels: DataFrame, key: str) -> float:
    parts, centre, n = _cluster_sums(feats, labels, key)
    k = len(parts)
    between = sum(p["n"] * float(((p["m"] - centre) ** 2).sum()) for p in parts)
    within = sum(p["ss"] for p in parts)
    return between * (n - k) / (within * (k - 1)) if within else 1.0


def davies_bouldin(feats: DataFrame, labels: DataFrame, key: str) -> float:
    parts, _, _ = _cluster_sums(feats, labels, key)
    centres = np.array([p["m"] for p in parts])
    index = F.create_map(*[F.lit(v) for i, p in enumerate(parts) for v in (p["cluster"], i)])
    table = F.array(*[F.array(*[F.lit(float(x)) for x in p["m"]]) for p in parts])
    to_own = F.sqrt(arrays.total(F.zip_with("features", F.element_at(table, F.element_at(index, F.col("cluster")) + 1),
                                            lambda x, y: (x - y) * (x - y))))
    spread = {r["cluster"]: r["s"] for r in feats.join(labels, key).groupBy("cluster").agg(F.avg(to_own).alias("s")).collect()}
    s = np.array([spread[p["cluster"]] for p in parts])
    d = distance.distances(centres, centres)
    ratio = np.where(d > 0, (s[:, None] + s[None, :]) / np.where(d > 0, d, 1), 0)
    np.fill_diagonal(ratio, 0)
    return float(ratio.max(1).mean())


def bic(feats: DataFrame, labels: DataFrame, key: str) -> float:
    """Bayesian information criterion of a clustering; larger is better."""
    parts, centre, n = _cluster_sums(feats, labels, key)
    k, d = len(parts), len(centre)
    loglik = 0.0
    for p in parts:
        variance = p["ss"] / (p["n"] - 1) if p["n"] > 1 else math.nan
        if not variance > 0:
            continue
        loglik += p["n"] * (math.log(p["n"]) - math.log(n) - d / 2 * math.log(2 * math.pi * variance) - (p["n"] - 1) / 2)
    return loglik - ((k - 1) + d * k + 1) / 2 * math.log(n)


def silhouette(feats: DataFrame, labels: DataFrame, key: str) -> float:
    """Mean silhouette on squared distances, which needs only per-cluster sums."""
    joined = feats.join(labels, key).withColumn("v", array_to_vector("features"))
    return ClusteringEvaluator(featuresCol="v", predictionCol="cluster", metricName="silhouette").evaluate(joined)


# criterion -> (function, larger is better)
K_CRITERIA = {"silhouette": (silhouette, True), "calinski_harabasz": (calinski_harabasz, True),
              "davies_bouldin": (davies_bouldin, False), "bic": (bic, True)}


def default_max_k(n_rows: int) -> int:
    return min(20, n_rows // 4)


def score_k(feats: DataFrame, key: str, method: str = "silhouette", max_k: int | None = None, fit: Callable = kmeans, **options) -> DataFrame:
    """(k, score, best) with every K from 2 up, for the clustering ``fit(feats, key, k, **options)``."""
    fn, larger = K_CRITERIA[method]
    top = max_k or default_max_k(feats.count())
    scores = {k: fn(feats, checkpoint(fit(feats, key, k, **options)), key) for k in range(2, top + 1)}
    best = (max if larger else min)(scores, key=scores.__getitem__)
    return feats.sparkSession.createDataFrame([(k, float(s), k == best) for k, s in scores.items()],
                                              "k int, score double, best boolean")


def _dispersion(feats: DataFrame, key: str, k: int, seed: int, n_init: int, fit: Callable | None = None) -> float:
    if k == 1 or fit is not None:
        labels = feats.select(key, F.lit(0).alias("cluster")) if k == 1 else checkpoint(fit(feats, key, k, seed=seed))
        return sum(p["ss"] for p in _cluster_sums(feats, labels, key)[0])
    return _fit_kmeans(feats, k, n_init, 300, seed)[0].summary.trainingCost


def gap_statistic(df: DataFrame, key: str, samples: Sequence[str], max_k: int | None = None, n_refs: int = 10,
                  power_transform: bool = True, n_init: int = 1, seed: int = 0, fit: Callable | None = None) -> DataFrame:
    """(k, gap, error, best), for k-means or for ``fit(feats, key, k, seed=...)``. Reference tables are uniform in the principal axes of the data and are generated where
    they are used; K is the smallest with Gap(K) >= Gap(K+1) - S(K+1), not counting 1."""
    n = df.count()
    top = max_k or default_max_k(n)
    raw = checkpoint(df.select(key, F.array(*[F.col(c).cast("double") for c in samples]).alias("features")))
    mean, axes = principal_axes(raw)
    projected = raw.select(_project(F.col("features"), mean, axes).alias("p"))
    edges = projected.agg(*[F.min(F.col("p")[i]).alias(f"a{i}") for i in range(len(samples))],
                          *[F.max(F.col("p")[i]).alias(f"b{i}") for i in range(len(samples))]).first()

    def reference(r: int) -> DataFrame:
        z = F.array(*[F.rand(seed * 1000 + r * 100 + i) * (edges[f"b{i}"] - edges[f"a{i}"]) + edges[f"a{i}"]
                      for i in range(len(samples))])
        drawn = checkpoint(df.sparkSession.range(n).select(F.col("id").alias(key), z.alias("z")))
        back = drawn.select(key, *[(arrays.total(F.zip_with("z", F.array(*[F.lit(float(v)) for v in axes[:, j]]), lambda a, b: a * b))
                                    + F.lit(float(mean[j]))).alias(c) for j, c in enumerate(samples)])
        return prepare(scalar.shift_to_baseline(back, samples), key, samples, power_transform)

    observed = prepare(df, key, samples, power_transform)
    references = [reference(r) for r in range(n_refs)]
    ks = list(range(1, top + 1))
    gaps, errors = [], []
    for k in ks:
        logs = np.log([_dispersion(ref, key, k, seed, n_init, fit) for ref in references])
        gaps.append(float(logs.mean() - math.log(_dispersion(observed, key, k, seed, n_init, fit))))
        errors.append(float(logs.std() * math.sqrt(1 + 1 / n_refs)))
    good = [ks[i] for i in range(len(ks) - 1) if gaps[i] - gaps[i + 1] + errors[i + 1] >= 0 and ks[i] > 1]
    best = good[0] if good else ks[-1]
    return df.sparkSession.createDataFrame([(k, g, e, k == best) for k, g, e in zip(ks, gaps, errors)],
                                           "k int, gap double, error double, best boolean")


def principal_axes(feats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes (rows) of the feature columns, from one aggregate of column products."""
    d = len(feats.select("features").first()["features"])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = feats.agg(*[F.avg(F.col("features")[i]).alias(f"m{i}") for i in range(d)],
                    *[F.covar_pop(F.col("features")[i], F.col("features")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    _, vectors = np.linalg.eigh(cov)
    return np.array([row[f"m{i}"] for i in range(d)]), vectors.T[::-1]


def _project(features: Column, mean: np.ndarray, axes: np.ndarray) -> Column:
    centred = F.zip_with(features, F.array(*[F.lit(float(v)) for v in mean]), lambda x, m: x - m)
    return F.array(*[arrays.total(F.zip_with(centred, F.array(*[F.lit(float(v)) for v in axis]), lambda x, a: x * a))
                     for axis in axes])


# --- consensus of several solutions -----------------------------------------------------------------------------------------

def expand_setups(parameter_dicts: Sequence[Mapping], power_transform: Sequence[bool] = (True,)) -> list[dict]:
    """Every combination of the listed parameter values per method; unknown methods are an error."""
    methods = {"kmeans", "kmedoids", "hierarchical", "hdbscan"}
    setups = []
    for d in parameter_dicts:
        if d.get("method", "").lower() not in methods:
            raise ValueError(f"unknown clustering method {d.get('method')!r}")
        names = [k for k in d if k != "method"]
        options = [d[k] if isinstance(d[k], (list, tuple)) else [d[k]] for k in names]
        for power, *values in itertools.product(power_transform, *options):
            setup = {"method": d["method"].lower(), "power_transform": power, **dict(zip(names, values))}
            if setup.get("n_clusters", 2) >= 2 and setup.get("eps", 1) > 0:
                setups.append(setup)
    return setups


def run_setups(df: DataFrame, key: str, setups: Sequence[Mapping], sample_groups: Sequence[Sequence[str]]) -> DataFrame:
    """(solution, cluster, key) for every setup and sample group; unclustered rows are left out."""
    runners = {"kmeans": kmeans, "kmedoids": kmedoids, "hierarchical": hierarchical, "hdbscan": hdbscan, "radius": density_clusters}
    prepared: dict[tuple, DataFrame] = {}
    out = None
    for number, (setup, group) in enumerate(itertools.product(setups, sample_groups)):
        slot = (setup["power_transform"], tuple(group))
        if slot not in prepared:
            prepared[slot] = prepare(df, key, group, setup["power_transform"])
        options = {k: v for k, v in setup.items() if k not in ("method", "power_transform")}
        method = "radius" if setup["method"] == "hdbscan" and "eps" in options else setup["method"]
        labels = runners[method](prepared[slot], key, **options).filter(F.col("cluster") != UNCLUSTERED)
        part = labels.select(F.lit(number).alias("solution"), "cluster", key)
        out = part if out is None else out.unionByName(part)
    return checkpoint(out)


def evidence_for_pairs(solutions: DataFrame, pairs: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """Share of solutions that put the two features of each given pair together."""
    n = solutions.select("solution").distinct().count()
    left = solutions.select(F.col(key).alias(a), "solution", F.col("cluster").alias("__ca"))
    right = solutions.select(F.col(key).alias(b), "solution", F.col("cluster").alias("__cb"))
    wanted = pairs.select(a, b).distinct()
    same = wanted.join(left, a).join(right, [b, "solution"]).filter("__ca = __cb").groupBy(a, b).agg(
        F.count(F.lit(1)).alias("n"))
    return wanted.join(same, [a, b], "left").select(a, b, (F.coalesce("n", F.lit(0)) / F.lit(float(n))).alias("evidence"))


def cluster_similarity(solutions: DataFrame, key: str) -> DataFrame:
    """(a, b, similarity) for clusters of all solutions: the mean share of solutions in which a member of one and a
    member of the other are together.

    A feature meets only the clusters it is in (one per solution), so the pair counts stay linear in the rows.
    """
    named = solutions.select(F.concat_ws(":", "solution", "cluster").alias("c"), key, "solution")
    n = solutions.select("solution").distinct().count()
    memberships = named.groupBy(key).agg(F.count(F.lit(1)).alias("m"), F.collect_list("c").alias("cs"))
    overlaps = checkpoint(memberships.select("m", F.explode("cs").alias("a"), "cs").select("m", "a", F.explode("cs").alias("b"))
                          .groupBy("a", "b").agg(F.count(F.lit(1)).alias("x"), F.sum("m").alias("mm")))
    sizes = overlaps.filter("a = b").select(F.col("a").alias("c"), F.col("x").alias("size"))
    via = overlaps.select("a", F.col("b").alias("c"), F.col("x").alias("xa")).join(
        overlaps.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("x").alias("xb")), "c").filter("a < b").groupBy(
        "a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("joint"))
    shared = overlaps.filter("a < b").select("a", "b", F.col("x").alias("both"), F.col("mm").alias("members"))
    return (via.join(shared, ["a", "b"], "left").fillna(0, ["both", "members"])
            .join(sizes.select(F.col("c").alias("a"), F.col("size").alias("na")), "a")
            .join(sizes.select(F.col("c").alias("b"), F.col("size").alias("nb")), "b")
            .select("a", "b", ((F.col("joint") - F.col("members") + F.lit(n) * F.col("both"))
                               / (F.lit(n) * F.col("na") * F.col("nb"))).alias("similarity")))


def _alike_nodes(need: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links (a, b) that span the nodes of two chunks (``side`` 0 and 1; one chunk alone has only 0) with ``need`` clusters in common."""
    def links(group: pd.DataFrame) -> pd.DataFrame:
        # the place of a cluster among those of its solution; -1 for no cluster
        codes = np.stack([pd.factorize(np.array(c, dtype=object))[0] for c in zip(*group["codes"])], axis=1).astype(np.int32)
        side = group["side"].to_numpy()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        label = np.arange(len(group))
        found: list[np.ndarray] = []
        for i in left:
            same = ((codes[right] == codes[i]) & (codes[i] >= 0)).sum(1) >= need
            near = right[same]
            apart = near[label[near] != label[i]]
            if len(apart):
                # one link to each component that is not yet joined to this node's
                _, first = np.unique(label[apart], return_index=True)
                ends = apart[first]
                found.append(np.stack([np.full(len(ends), i), ends], axis=1))
                joined = np.append(label[ends], label[i])
                label[np.isin(label, joined)] = joined.min()
        pairs = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
        ids = group["id"].to_numpy()
        return pd.DataFrame({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})
    return links


def feature_consensus(solutions: DataFrame, key: str, evidence_threshold: float = 2 / 3, min_cluster_size: int = 15,
                      chunk_rows: int = 2048) -> DataFrame:
    """Clusters of features linked by being together in at least ``evidence_threshold`` of the solutions; others are -1.

    Features with the same clusters in all solutions become one node. Two nodes with t clusters in common share one among the rarest
    m - t + 1 of each one's m clusters, so only nodes that do meet, in chunks of ``chunk_rows`` against chunks, where links that span them
    are kept. A node in fewer than t solutions, and a feature that is linked to none, has no cluster. A solution puts a feature
    into one cluster at most; the smallest counts where it has several.
    """
    if not evidence_threshold > 0:
        raise ValueError("evidence_threshold must be above 0")
    ids = sorted(r[0] for r in solutions.select("solution").distinct().collect())
    need = next((t for t in range(1, len(ids) + 1) if t / len(ids) >= evidence_threshold), len(ids) + 1)
    single = solutions.groupBy(key, "solution").agg(F.min(F.col("cluster").cast("string")).alias("cluster"))
    taken = F.map_from_entries(F.collect_list(F.struct("solution", "cluster")))
    codes = F.array(*[F.try_element_at("__m", F.lit(i)) for i in ids])
    vectors = checkpoint(single.groupBy(key).agg(taken.alias("__m")).select(key, codes.alias("codes")))
    weighted = vectors.groupBy("codes").agg(F.count(F.lit(1)).alias("n")).filter(F.size(F.array_compact("codes")) >= need)
    nodes = checkpoint(row_numbers(weighted, [], ["codes"], "id").select("id", "codes", "n"))
    members = nodes.select("id", "codes", F.posexplode("codes").alias("at", "cluster")).filter("cluster IS NOT NULL")
    spread_of = checkpoint(members.groupBy("at", "cluster").agg(F.count(F.lit(1)).alias("nodes")))
    known = lookup(members.select("id", "at", "cluster"), spread_of, ["at", "cluster"], spread_of.filter("nodes >= 100000").orderBy(F.desc("nodes")).limit(1000))
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("nodes", "at", "cluster"))), 1, F.count(F.lit(1)).cast("int") - need + 1)
    met = known.groupBy("id").agg(rarest.alias("prefix")).select("id", F.explode("prefix").alias("p")).select("id", "p.at", "p.cluster")
    sizes = checkpoint(met.groupBy("at", "cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk_rows)).cast("int").alias("chunks"), F.count(F.lit(1)).alias("k")).filter("k > 1"))
    dealt = lookup(met, sizes, ["at", "cluster"], sizes.filter("k >= 100000").orderBy(F.desc("k")).limit(1000)).filter("chunks IS NOT NULL").join(
        nodes.select("id", "codes"), "id").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    # chunk i meets itself and every other chunk once, the smaller number on side 0
    meetings = dealt.select("id", "codes", "at", "cluster", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "id", "codes", "at", "cluster", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"))
    kind = nodes.schema["id"].dataType.simpleString()
    links = checkpoint(meetings.groupBy("at", "cluster", "low", "high").applyInPandas(_alike_nodes(need), f"a {kind}, b {kind}"))
    named = checkpoint(connected_components(nodes.withColumnRenamed("id", "node"), links).join(nodes.withColumnRenamed("id", "node"), "node"))
    known_nodes = named.select("codes", F.col("component").alias("cluster"), "n")
    placed = lookup(vectors, known_nodes, ["codes"], known_nodes.filter("n >= 100000").orderBy(F.desc("n")).limit(1000)).select(key, "cluster")
    # clusters of equal size are ordered by their smallest feature
    smallest = placed.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.min(key).alias("__name"))
    return number_clusters(placed.join(smallest, "cluster", "left").select(key, F.col("__name").alias("cluster")), key, max(2, min_cluster_size))


def consensus(solutions: DataFrame, key: str, evidence_threshold: float = 2 / 3, cluster_unclustered: bool = True,
              min_cluster_size: int = 15, by: str = "auto", n_features: int | None = None) -> DataFrame:
    """Blocks of similar clusters vote for each feature (``by="cluster"``), or features are linked themselves (``by="feature"``); small
    blocks and features without votes are -1. ``auto`` links features when there are at least 4 clusters per square root of the
    features (``n_features``, or those with a cluster)."""
    if by not in ("auto", "cluster", "feature"):
        raise ValueError("by must be auto, cluster or feature")
    names = checkpoint(solutions.select(F.concat_ws(":", "solution", "cluster").alias("node")).distinct())
    if by == "auto":
        n_features = n_features or solutions.select(key).distinct().count()
        by = "feature" if names.count() >= 4 * math.sqrt(n_features) else "cluster"
    if by == "feature":
        return feature_consensus(solutions, key, evidence_threshold, min_cluster_size)
    similar = checkpoint(cluster_similarity(solutions, key))
    links = similar.filter(F.col("similarity") >= evidence_threshold)
    blocks = connected_components(names, links.select("a", "b"))
    sizes = blocks.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    used = blocks.join(sizes, "component").filter("n > 1").select("node", "component") if not cluster_unclustered else blocks
    votes = solutions.withColumn("node", F.concat_ws(":", "solution", "cluster")).join(used, "node").groupBy(
        key, "component").agg(F.count(F.lit(1)).alias("v"))
    # most votes, then the smallest block name
    winner = votes.groupBy(key).agg(F.min(F.struct((-F.col("v")).alias("v"), "component")).alias("w")).select(
        key, F.col("w.component").alias("component"))
    keys = solutions.select(key).distinct()
    return number_clusters(keys.join(winner.withColumnRenamed("component", "cluster"), key, "left"), key, min_cluster_size)


# --- profiles ------------------------------------------------------------------------------------------------------------------

def cluster_profiles(feats: DataFrame, labels: DataFrame, key: str, samples: Sequence[str]) -> DataFrame:
    """(cluster, sample, mean, std) of the transformed values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("sample"), F.col("features")[i].alias("x")) for i, c in enumerate(samples)])
    return (feats.join(labels.filter(F.col("cluster") != UNCLUSTERED), key).select("cluster", F.inline(pairs))
            .groupBy("cluster", "sample").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")))


def clustered_projection(feats: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, cluster, pc1, pc2): the clustered rows on their two main axes."""
    mean, axes = principal_axes(feats)
    p = _project(F.col("features"), mean, axes[:2])
    return feats.join(labels, key).select(key, "cluster", p[0].alias("pc1"), p[1].alias("pc2"))


def clustergram(df: DataFrame, key: str, samples: Sequence[str], z_score: bool = False) -> DataFrame:
    """log2(x + 1), optionally centred and scaled inside each row."""
    logs = {c: F.log2(F.col(c) + 1) for c in samples}
    if not z_score:
        return df.select(key, *[e.alias(c) for c, e in logs.items()])
    row = df.select(key, F.array(*logs.values()).alias("v"))
    m, s = arrays.mean(F.col("v")), arrays.std(F.col("v"))
    return row.select(key, *[((F.col("v")[i] - m) / F.when(s > 0, s).otherwise(1.0)).alias(c) for i, c in enumerate(samples)])
