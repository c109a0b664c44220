"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of each pair (a, b) in place; a label is the smallest place of its tree."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of one task as stars: each node but the smallest of its component here, with that smallest one."""
    parts = [b for b in batches if len(b)]
    if parts:
        edges = pd.concat(parts, ignore_index=True)
        names, places = np.unique(np.concatenate([edges["node"].to_numpy(), edges["parent"].to_numpy()]), return_inverse=True)
        labels = np.arange(len(names))
        merge_labels(labels, places[:len(edges)], places[len(edges):])
        moved = np.flatnonzero(labels != np.arange(len(names)))
        yield pd.DataFrame({"node": names[moved], "parent": names[labels[moved]]})


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b", salts: int = 8) -> DataFrame:
    """(node, component): the smallest node ID of each component.

    Tasks turn their edges into stars around local minima, before and after a shuffle by node, until every node has one smaller
    parent: a forest with the components of the graph. A hub sends one edge from each task. Then nodes take the parent of their
    parent until nothing moves, over ``salts`` copies of the parents, so that the members of a giant component are spread.
    """
    kind = nodes.schema[node].dataType.simpleString()
    stars = f"node {kind}, parent {kind}"
    forest = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("parent"))
    while True:
        forest = checkpoint(forest.mapInPandas(_stars, stars).repartition("node").mapInPandas(_stars, stars))
        if forest.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            break
    while True:
        up = forest.select(F.col("node").alias("parent"), F.col("parent").alias("__up"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
        dealt = forest.withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
        moved = checkpoint(dealt.join(up, ["parent", "__salt"], "left").select(
            "node", F.coalesce("__up", "parent").alias("parent"), F.col("__up").isNotNull().alias("__moved")))
        forest = moved.select("node", "parent")
        if moved.filter("__moved").isEmpty():
            break
    known = forest.select(F.col("node").alias(node), F.col("parent").alias("component"))
    return nodes.select(node).distinct().join(known, node, "left").select(node, F.coalesce("component", node).alias("component"))
