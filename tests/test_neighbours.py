"""Exact single linkage, density clusters and components against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions import distance
from keyloom.operators import cluster, graphs, neighbours


def _brute(points, eps, metric, min_samples):
    d = distance.distances(points, points, metric) <= eps
    core = d.sum(1) >= min_samples
    label = np.where(core, np.arange(len(points)), -1)
    while True:
        new = np.array([min(label[j] for j in range(len(points)) if core[j] and d[i, j]) if core[i] else -1 for i in range(len(points))])
        if (new == label).all():
            return label
        label = new


def _table(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "gene long, features array<double>")


def _same_partition(labels, want):
    pairs = {(labels[i], int(w)) for i, w in enumerate(want)}
    return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}) and all((a == -1) == (b == -1) for a, b in pairs)


def test_close_rows_are_not_merged_before_measuring(spark):
    labels = cluster.hierarchical(_table(spark, [[0.0], [0.09], [1.0]]), "gene", distance_threshold=0.95)
    assert {r["cluster"] for r in labels.collect()} == {0}


@pytest.mark.parametrize("metric,eps", [("euclidean", 0.5), ("manhattan", 0.8), ("sqeuclidean", 0.2), ("cosine", 0.01), ("pearson", 0.02)])
@pytest.mark.parametrize("min_samples", [1, 4])
def test_density_clusters_match_brute_force(spark, metric, eps, min_samples):
    points = np.random.default_rng(3).normal(size=(120, 4)).round(2)
    points[100:] = points[:20]  # repeated rows
    labels = {r["gene"]: r["cluster"] for r in cluster.density_clusters(_table(spark, points), "gene", eps, min_samples, 1, metric).collect()}
    assert _same_partition(labels, _brute(points, eps, metric, min_samples))


def test_chunks_of_a_crowded_box_meet(spark):
    points = np.random.default_rng(4).normal(scale=0.2, size=(90, 2)).round(3)
    table = _table(spark, points).select(F.col("gene").alias("node"), F.col("features").alias("p"))
    counts = {r["node"]: r["n"] for r in neighbours.neighbour_counts(table, 0.1, chunk_rows=16).collect()}
    assert counts == dict(enumerate((distance.distances(points, points) <= 0.1).sum(1)))
    links = neighbours.neighbour_links(table, 0.1, chunk_rows=16)
    labels = {r["node"]: r["component"] for r in graphs.connected_components(table.select("node"), links).collect()}
    assert _same_partition(labels, _brute(points, 0.1, "euclidean", 1))


def test_components_of_a_star_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 200)] + [(300 + i, 301 + i) for i in range(60)]
    table = spark.createDataFrame(edges, "a long, b long")
    nodes = spark.range(400).withColumnRenamed("id", "node")
    got = {r["node"]: r["component"] for r in graphs.connected_components(nodes, table).collect()}
    assert got == {i: 0 if i < 200 else 300 if 300 <= i <= 360 else i for i in range(400)}


def _blobs(spark):
    rng = np.random.default_rng(6)
    rows = [(f"g{c}_{i}", *map(float, 50 + 40 * np.eye(3)[c] + rng.normal(size=3))) for c in range(3) for i in range(12)]
    return spark.createDataFrame(rows, "gene string, a double, b double, c double")


@pytest.mark.parametrize("split,options", [("split_kmedoids", {"metric": "manhattan"}), ("split_hierarchical", {}), ("split_kmeans", {})])
def test_k_is_chosen_by_a_criterion_for_every_method(spark, split, options):
    from keyloom.table import CountTable
    table = CountTable(_blobs(spark), "gene")
    out = getattr(table, split)("silhouette", max_k=4, power_transform=False, **options).df
    groups = {r["gene"]: r["cluster"] for r in out.select("gene", "cluster").collect()}
    assert len({(g[:2], c) for g, c in groups.items()}) == 3 == len(set(groups.values()))
    two, three = getattr(table, split)([2, 3], power_transform=False, **options)
    assert two.df.select("cluster").distinct().count() == 2 and three.df.select("cluster").distinct().count() == 3


def test_medoids_are_the_best_members(spark):
    points = np.random.default_rng(9).normal(size=(60, 3))
    table = _table(spark, points)
    medoids = cluster.fit_kmedoids(table, "gene", 3, metric="manhattan", seed=2)
    d = distance.distances(points, medoids, "manhattan")
    labels = d.argmin(1)
    for c in range(3):
        own = points[labels == c]
        costs = distance.distances(own, own, "manhattan").sum(0)
        assert d[labels == c, c].sum() == pytest.approx(costs.min())


@pytest.mark.parametrize("metric", ["cosine", "pearson", "spearman"])
def test_totals_of_inner_product_distances_need_no_meetings(spark, metric, monkeypatch):
    points = np.random.default_rng(10).normal(size=(80, 5)).round(1)
    points[70:] = points[:10]
    points[3] = 0.0
    table = _table(spark, points).select(F.col("gene").alias("node"), F.col("features").alias("p"), (F.col("gene") % 3).cast("string").alias("box"))
    monkeypatch.setattr(neighbours, "_deal", lambda *_: pytest.fail("rows met"))
    got = {r["node"]: r["cost"] for r in neighbours.distance_sums(table, metric).collect()}
    for i in range(80):
        assert got[i] == pytest.approx(distance.distances(points[[i]], points[i % 3::3], metric).sum())


def _visits_counted(monkeypatch):
    seen = []
    real = neighbours._visited
    monkeypatch.setattr(neighbours, "_visited", lambda index, rows, *more: (seen.append(rows.count()), real(index, rows, *more))[1])
    return seen


def test_only_rows_outside_the_largest_component_visit_other_cells(spark, monkeypatch):
    points = np.concatenate([np.random.default_rng(11).normal(size=(400, 4)), np.full((3, 4), 9.0)])
    table = _table(spark, points).select(F.col("gene").alias("node"), F.col("features").alias("p"))
    seen = _visits_counted(monkeypatch)
    links = neighbours.neighbour_links(table, 1.2, chunk_rows=16)
    labels = {r["node"]: r["component"] for r in graphs.connected_components(table.select("node"), links).collect()}
    assert _same_partition(labels, _brute(points, 1.2, "euclidean", 1))
    core = {r["node"] for r in neighbours.core_rows(table, 1.2, 4, chunk_rows=64).collect()}
    assert core == set(np.flatnonzero((distance.distances(points, points) <= 1.2).sum(1) >= 4))
    assert len(seen) == 2 and max(seen) < 300
