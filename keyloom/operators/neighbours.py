"""Exact neighbour counts and links within a radius, without emitting pairs.

Rows meet in boxes: of a grid where there are few axes, else in cells around pivots. A row is at home in one box and visits those that may hold a
row within the radius, so all its neighbours visit its home. Boxes with many rows are cut into chunks of homes and chunks of visitors that meet task by task. A
task measures real rows against real rows; it returns one count per home row, or a spanning set of links.

Around pivots most rows need no visit: a row with enough neighbours at home is a core row, and of two rows of different components one is not in the
largest, so after a first round only rows outside it visit all the cells within the radius.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance
from ..session import checkpoint
from .graphs import connected_components
from .pivots import Cells, cells, chord, visits

#: Coordinates of rows within a distance differ by no more than that distance (its root for squares).
BOXED = {"euclidean", "l2", "manhattan", "cityblock", "l1", "chebyshev", "sqeuclidean"}


def _meetings(points: DataFrame, radius: float, metric: str, axes: int, chunk_rows: int) -> DataFrame:
    """(box, c, v, home, node, p): chunk c of the homes of a box meets chunk v of its visitors. Boxes are those of a grid where it has all the axes,
    else cells around pivots."""
    if _gridded(points, radius, metric, axes):
        dims = len(points.select("p").first()["p"])
        side = (radius ** 0.5 if metric == "sqeuclidean" else radius) * (1 + 1e-9)
        own = F.array(*[F.floor(F.get("p", F.lit(i)) / side) for i in range(dims)])
        around = F.array(*[F.array(*[F.floor(F.get("p", F.lit(i)) / side) + s for i, s in enumerate(shift)])
                           for shift in itertools.product((-1, 0, 1), repeat=dims)])
        homes = points.select(own.alias("box"), "node", "p")
        visitors = points.select(F.explode(around).alias("box"), "node", "p")
        text = F.concat_ws(",", F.transform("box", lambda x: x.cast("string")))
        return _deal(homes.withColumn("box", text), visitors.withColumn("box", text), chunk_rows)
    index = cells(points, metric, chunk_rows)
    return _visited(index, index.rows, radius, chunk_rows)


def _visited(index: Cells, rows: DataFrame, radius: float, chunk_rows: int) -> DataFrame:
    """(box, c, v, home, node, p): ``rows`` of the index visit all cells that may hold a row within the radius."""
    homes = index.rows.select(F.col("cell").cast("string").alias("box"), "node", "p")
    visitors = visits(Cells(rows, index.bounds), F.lit(float(radius))).filter("v = 0").select(F.col("box").cast("string").alias("box"), "node", "p")
    return _deal(homes, visitors, chunk_rows, _tasks_for(index))


def _tasks_for(index: Cells) -> int:
    """Tasks that hold a few chunks each: measuring is long for the bytes it reads, by which small partitions would be put together."""
    return int(min(max(1, index.bounds.chunks.sum() // 4), 4000))


def _gridded(points: DataFrame, radius: float, metric: str, axes: int) -> bool:
    some = points.select("p").first() if metric in BOXED and radius > 0 else None
    return some is not None and 0 < len(some["p"]) <= axes


def _deal(homes: DataFrame, visitors: DataFrame, chunk_rows: int, tasks: int | None = None) -> DataFrame:
    """Cut the homes and the visitors of each box into chunks and let every two of them meet."""
    home_chunks = homes.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("__h"))
    chunks = visitors.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("__v")).join(home_chunks, "box")

    def dealt(rows: DataFrame, own: str, other: str, mine: str, theirs: str, home: bool) -> DataFrame:
        return rows.join(chunks, "box").select(
            "box", F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs), F.lit(home).alias("home"), "node", "p").select(
            "box", "c", "v", "home", "node", "p")
    met = dealt(homes, "__h", "__v", "c", "v", True).union(dealt(visitors, "__v", "__h", "v", "c", False))
    return met.repartition(*([tasks] if tasks else []), "box", "c", "v").sortWithinPartitions("box", "c", "v")


def distance_sums(points: DataFrame, metric: str = "euclidean", chunk_rows: int = 2048) -> DataFrame:
    """(node, cost): total distance of each row of ``points`` (node, p, box) to all rows of its box. Where the distance comes from inner products
    that is one product with the sum of the box; with other distances all rows of a box meet, chunk by chunk."""
    kind = points.schema["node"].dataType.simpleString()
    if metric in distance.PRODUCTS:
        return _product_sums(points, metric)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _tasks(batches):
            homes, visitors = rows[rows["home"]], rows[~rows["home"]]
            if len(homes) and len(visitors):
                d = distance.distances(np.stack(homes["p"].to_numpy()), np.stack(visitors["p"].to_numpy()), metric)
                yield pd.DataFrame({"node": homes["node"], "cost": d.sum(1)})
    rows = points.select("box", "node", "p")
    return _deal(rows, rows, chunk_rows).mapInPandas(run, f"node {kind}, cost double").groupBy("node").agg(F.sum("cost").alias("cost"))


def _product_sums(points: DataFrame, metric: str) -> DataFrame:
    shape, share = distance.PRODUCTS[metric]
    kinds = {c: points.schema[c].dataType.simpleString() for c in ("node", "box")}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for box, rows in pdf.groupby("box"):
                yield pd.DataFrame({"box": [box], "n": [len(rows)], "s": [shape(np.stack(rows["p"].to_numpy()).astype(float)).sum(0)]})

    def cost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                # the sum of products row by row, so that equal rows have equal costs
                products = (shape(np.stack(pdf["p"].to_numpy()).astype(float)) * np.stack(pdf["s"].to_numpy())).sum(1)
                yield pd.DataFrame({"node": pdf["node"], "cost": share * (pdf["n"].to_numpy() - products)})
    parts = points.select("box", "p").mapInPandas(add, f"box {kinds['box']}, n long, s array<double>")
    sizes = parts.groupBy("box").agg(F.sum("n").alias("n"))
    sums = parts.select("box", F.posexplode("s").alias("at", "x")).groupBy("box", "at").agg(F.sum("x").alias("x")).groupBy("box").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("s"))
    known = sizes.join(sums, "box")
    costs = points.select("box", "node", "p").join(known, "box").select("node", "p", "n", "s").mapInPandas(cost, f"node {kinds['node']}, cost double")
    return costs.groupBy("node").agg(F.sum("cost").alias("cost"))


def _tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, key = [], None
    for batch in batches:
        for own, rows in batch.groupby(["box", "c", "v"], sort=False):
            if held and own != key:
                yield pd.concat(held)
                held = []
            key = own
            held.append(rows)
    if held:
        yield pd.concat(held)


def _near(rows: pd.DataFrame, radius: float, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    homes, visitors = rows[rows["home"]], rows[~rows["home"]]
    if not len(homes) or not len(visitors):
        return homes["node"].to_numpy(), visitors["node"].to_numpy(), np.zeros((len(homes), len(visitors)), dtype=bool)
    x, y = np.stack(homes["p"].to_numpy()), np.stack(visitors["p"].to_numpy())
    near = np.concatenate([distance.distances(x, y[at:at + 2048], metric) <= radius for at in range(0, len(y), 2048)], axis=1)
    return homes["node"].to_numpy(), visitors["node"].to_numpy(), near


def _spanning(homes: np.ndarray, visitors: np.ndarray, near: np.ndarray) -> pd.DataFrame:
    """Links (a, b) that span the components of homes and visitors that are near each other."""
    left, links = near.any(1), []
    while left.any():  # grow one component from an unused home at a time
        start = int(np.flatnonzero(left)[0])
        mine, reached = np.zeros(len(homes), dtype=bool), np.zeros(len(visitors), dtype=bool)
        front = np.zeros(len(homes), dtype=bool)
        front[start] = True
        while front.any():
            mine |= front
            new = near[front].any(0) & ~reached
            reached |= new
            front = near[:, new].any(1) & ~mine
        left &= ~mine
        links += [(homes[start], x) for x in {*homes[mine], *visitors[reached]} if x != homes[start]]
    return pd.DataFrame(links, columns=["a", "b"])


def neighbour_counts(points: DataFrame, radius: float, metric: str = "euclidean", axes: int = 3, chunk_rows: int = 2048) -> DataFrame:
    """(node, n): rows of ``points`` (node, p) within ``radius`` of each, itself included."""
    kind = points.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _tasks(batches):
            nodes, _, near = _near(rows, radius, metric)
            yield pd.DataFrame({"node": nodes, "n": near.sum(1)})
    counted = _meetings(points, radius, metric, axes, chunk_rows).mapInPandas(run, f"node {kind}, n long")
    return counted.groupBy("node").agg(F.sum("n").alias("n"))


def core_rows(points: DataFrame, radius: float, least: int, metric: str = "euclidean", axes: int = 3, chunk_rows: int = 2048) -> DataFrame:
    """(node): rows of ``points`` (node, p) with at least ``least`` rows within ``radius``, themselves included. Only rows without enough of them in the chunk of
    their cell look into other cells."""
    if _gridded(points, radius, metric, axes):
        return neighbour_counts(points, radius, metric, axes, chunk_rows).filter(F.col("n") >= least).select("node")
    kind = points.schema["node"].dataType.simpleString()
    index = cells(points, metric, chunk_rows)

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _tasks(batches):
            _, _, near = _near(pd.concat([rows, rows.assign(home=False)]), radius, metric)
            yield rows[["node", "p"]].assign(dense=near.sum(1) >= least)

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _tasks(batches):
            _, nodes, near = _near(rows, radius, metric)
            yield pd.DataFrame({"node": nodes, "n": near.sum(0)})
    home = index.rows.select(F.col("cell").alias("box"), F.col("chunk").alias("c"), F.col("chunk").alias("v"), F.lit(True).alias("home"), "node", "p")
    first = checkpoint(home.repartition(_tasks_for(index), "box", "c").sortWithinPartitions("box", "c").mapInPandas(at_home, f"node {kind}, p array<double>, dense boolean"))
    counted = _visited(index, first.filter("NOT dense").select("node", "p"), radius, chunk_rows).mapInPandas(seek, f"node {kind}, n long")
    found = counted.groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("node")
    return first.filter("dense").select("node").union(found)


def neighbour_links(points: DataFrame, radius: float, metric: str = "euclidean", axes: int = 3, chunk_rows: int = 2048) -> DataFrame:
    """(a, b): links with the same connected components as all pairs within ``radius``; fewer than the rows of each task.

    Around pivots rows first meet those of their chunk, of the next chunk of the cell and of a chunk of the second nearest cell. Rows that
    are then not in the largest component visit all cells within the radius."""
    kind = points.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _tasks(batches):
            yield _spanning(*_near(rows, radius, metric))
    if _gridded(points, radius, metric, axes):
        return _meetings(points, radius, metric, axes, chunk_rows).mapInPandas(run, f"a {kind}, b {kind}").distinct()
    index = cells(points, metric, chunk_rows)
    bounds, reachable = index.bounds, float((chord(metric) or (lambda d: d))(np.array(float(radius))))

    def guests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at:at + 4096]
                chords = bounds.chords(np.stack(part["p"].to_numpy()))
                chords[np.arange(len(part)), part["cell"].to_numpy()] = np.inf
                chords[:, bounds.sizes == 0] = np.inf
                second = chords.argmin(1)
                least = chords[np.arange(len(part)), second] - bounds.radius[second]
                yield part.assign(box=second.astype("int32"))[np.isfinite(least) & (least <= reachable)][["box", "node", "p"]]
    per_cell = lambda box: F.element_at(F.array(*[F.lit(int(c)) for c in bounds.chunks]), F.col(box) + 1)
    home = index.rows.select(F.col("cell").alias("box"), F.col("chunk").alias("c"), F.lit(True).alias("home"), "node", "p")
    again = home.withColumn("home", F.lit(False))
    along = again.withColumn("c", F.pmod(F.col("c") + 1, per_cell("box")).cast("int")).filter(per_cell("box") > 1)
    second = index.rows.mapInPandas(guests, f"box int, node {kind}, p array<double>").select(
        "box", F.pmod(F.xxhash64("node"), per_cell("box")).cast("int").alias("c"), F.lit(False).alias("home"), "node", "p")
    met = home.union(again).union(along).union(second).withColumn("v", F.col("c")).repartition(_tasks_for(index), "box", "c").sortWithinPartitions("box", "c")
    links = checkpoint(met.mapInPandas(run, f"a {kind}, b {kind}").distinct())
    groups = checkpoint(connected_components(points.select("node"), links))
    largest = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "component"))["component"].alias("c")).first()["c"]
    loose = index.rows.select("node", "p").join(groups.filter(F.col("component") != F.lit(largest)).select("node"), "node")
    more = _visited(index, loose, radius, chunk_rows).mapInPandas(run, f"a {kind}, b {kind}")
    return links.union(more).distinct()
