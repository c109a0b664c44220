"""Hard negatives by segment summaries.

Vectors travel in packs of bounded size. A pack stores, for every level of halving, mean and deviation of each segment of each vector. A
segment of n components with means m, m' and deviations s, s' adds between n(mm' - ss') and n(mm' + ss') to an inner product, so a level
bounds all scores of an anchor pack against a vector pack by two small matrix products. Levels go from one segment to segments of two
components; pairs whose bounds miss what is asked for are left, and only the rest are scored exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Vectors and anchors of a pack, and vector packs of a part that all anchor packs visit.
PACK_ROWS, ANCHOR_ROWS, PART_PACKS = 2048, 1024, 4
#: Below this share of pairs left by the bounds, pairs are scored one by one instead of as a matrix.
SPARSE = 1 / 16
#: Squared length from which an inner product might not fit a long.
LONGEST, LONGEST_COMPONENT = 2.0 ** 62, 2.0 ** 24

PACK = "dim int, ids binary, labels binary, vectors binary"
PLACE = "anchor_pack long, anchor_no int, anchor_id long"


def _packer(rows_at_once: int):
    """Packs of vectors of one dimension, in the order of their ids."""
    def pack(dim: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, labels, vectors = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((labels, ids))
        return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()],
                                           "vectors": [vectors[order].tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            lists = batch.column(2)
            dims = lists.value_lengths().to_numpy()
            flat = np.asarray(lists.flatten())
            starts = np.concatenate([[0], np.cumsum(dims)])
            ids, labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                vectors = flat[starts[own][:, None] + np.arange(dim)]
                for at in range(0, len(own), rows_at_once):
                    held.setdefault(int(dim), []).append((ids[own[at:at + rows_at_once]], labels[own[at:at + rows_at_once]], vectors[at:at + rows_at_once]))
                    if sum(len(p[0]) for p in held[int(dim)]) >= rows_at_once:
                        yield pack(int(dim), held.pop(int(dim)))
            if sum(len(p[0]) for parts in held.values() for p in parts) >= 4 * rows_at_once:  # many dimensions with few rows each
                for dim in list(held):
                    yield pack(dim, held.pop(dim))
        for dim, parts in held.items():
            yield pack(dim, parts)
    return run


def packs(rows: DataFrame, rows_at_once: int) -> DataFrame:
    """Stored packs of (vec_id, label, whole-number components)."""
    packed = rows.mapInArrow(_packer(rows_at_once), PACK)
    return store(packed.select(F.monotonically_increasing_id().alias("pack"), "*"))


def summaries(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(means, deviations) of the segments of each vector, both times the root of the segment's length, from one segment to segments of two."""
    levels, segments, dim = [], 1, vectors.shape[1]
    while segments * 2 <= dim:
        edges = np.linspace(0, dim, segments + 1).astype(int)
        sizes = np.diff(edges)
        sums = np.add.reduceat(vectors, edges[:-1], axis=1)
        squares = np.add.reduceat(vectors * vectors, edges[:-1], axis=1)
        levels.append((sums / np.sqrt(sizes), np.sqrt(np.maximum(squares - sums * sums / sizes, 0))))
        segments *= 2
    return levels


class Pack:
    """Arrays of a stored pack and their summaries."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, dim: int):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(len(self.ids), dim)
        self.levels = summaries(self.vectors)
        self.length = np.sqrt((self.vectors ** 2).sum(axis=1))
        # inner products of so short vectors are exact in doubles, whatever the order of adding
        self.small = bool((self.length < 2.0 ** 26).all())


def exact(a: np.ndarray, b: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b`` as integers."""
    if small:
        return np.rint(a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def scores(anchors: Pack, rows: Pack, wanted: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, tally: list[int] | None = None) -> tuple:
    """(anchors, rows, scores, mask): the part of the matrix of scores that may hold pairs of ``wanted`` with floor <= score <= ceiling of the
    anchor; mask says which of it are left by the bounds (scores of others are not computed where few are left)."""
    a, b = np.arange(len(anchors.ids)), np.arange(len(rows.ids))
    alive = wanted
    for (mean, spread), (mean2, spread2) in zip(anchors.levels, rows.levels):
        centre, width = mean[a] @ mean2[b].T, spread[a] @ spread2[b].T
        width += 1e-9 * anchors.length[a][:, None] * rows.length[b][None, :] + 1e-6  # rounding of the bounds themselves
        alive = alive & (centre + width >= floor[a][:, None]) & (centre - width <= ceiling[a][:, None])
        left, right = alive.any(axis=1), alive.any(axis=0)
        if not left.any():
            break
        if left.sum() * right.sum() < alive.size:
            a, b, alive = a[left], b[right], alive[np.ix_(left, right)]
    if tally is not None:
        tally[0] += int(wanted.sum())
        tally[1] += int(alive.sum())
    small = anchors.small and rows.small
    if alive.mean() < SPARSE if alive.size else True:
        i, j = np.nonzero(alive)
        found = np.zeros(alive.shape, dtype=np.int64)
        kind = np.float64 if small else np.int64
        for at in range(0, len(i), 65_536):
            part = slice(at, at + 65_536)
            found[i[part], j[part]] = np.einsum("nd,nd->n", anchors.vectors[a[i[part]]].astype(kind), rows.vectors[b[j[part]]].astype(kind))
    else:
        found = exact(anchors.vectors[a], rows.vectors[b], small)
    return a, b, found, alive


NONE = np.iinfo(np.int64).min


class Best:
    """The ``k`` largest scores of each of ``n`` anchors so far, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def add(self, anchors: np.ndarray, ids: np.ndarray, found: np.ndarray, mask: np.ndarray) -> None:
        """``ids`` ascend, so the first of equal scores has the smallest."""
        k = self.scores.shape[1]
        if not mask.any():
            return
        left = np.where(mask, found, NONE)
        lines = np.arange(len(anchors))
        new_scores, new_ids = [], []
        for _ in range(min(k, left.shape[1])):
            at = left.argmax(axis=1)
            new_scores.append(left[lines, at])
            new_ids.append(ids[at])
            left[lines, at] = NONE
        both = np.concatenate([self.scores[anchors], np.stack(new_scores, axis=1)], axis=1)
        names = np.concatenate([self.ids[anchors], np.stack(new_ids, axis=1)], axis=1)
        order = np.lexsort((names, ~both), axis=1)[:, :k]  # ~ turns the order round and cannot overflow
        self.scores[anchors], self.ids[anchors] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)


def _search(find):
    """Over rows sorted by part, vector packs first: each anchor pack of the part meets the part's vector packs, which alone are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for row in (r for n in range(batch.num_rows) for r in batch.slice(n, 1).to_pylist()):
                if row["part"] != part:
                    part, held = row["part"], []
                rows = Pack(row["ids"], row["labels"], row["vectors"], row["dim"])
                if not row["is_anchor"]:
                    held.append(rows)
                    continue
                search = find(rows, row["positives"] or [])
                for own in held:
                    if own.vectors.shape[1] == row["dim"]:
                        search.meet(own)
                for columns in search.results():
                    n = len(columns["anchor_no"])
                    if n:
                        yield pa.RecordBatch.from_pydict({"anchor_pack": pa.array([row["pack"]] * n, pa.int64())} | {
                            k: pa.array(v, pa.int32() if k in ("anchor_no", "place") else pa.int64()) for k, v in columns.items()})
    return run


def _limits(scores_of: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest negative scores of positives: low * positive <= 100 * negative <= high * positive; past each other where none fits."""
    least, most = [], []
    for s in scores_of.ravel().tolist():
        least.append(0 if s == NONE else -(-low * s // 100))
        most.append(-1 if s == NONE else high * s // 100)
    return np.array(least, np.int64).reshape(scores_of.shape), np.array(most, np.int64).reshape(scores_of.shape)


class Positives:
    """Best rows of the anchors' own labels."""

    def __init__(self, anchors: Pack, positives: list[dict], k: int):
        self.anchors, self.best = anchors, Best(len(anchors.ids), k)

    def meet(self, rows: Pack) -> None:
        wanted = (self.anchors.labels[:, None] == rows.labels[None, :]) & (self.anchors.ids[:, None] != rows.ids[None, :])
        floor = self.best.scores[:, -1].astype(np.float64)  # an equal score with a smaller id still counts
        a, b, found, mask = scores(self.anchors, rows, wanted, floor, np.full(len(floor), np.inf))
        self.best.add(a, rows.ids[b], found, mask)

    def results(self) -> Iterator[dict]:
        i, j = np.nonzero(self.best.scores != NONE)
        yield {"anchor_no": i, "anchor_id": self.anchors.ids[i], "positive_id": self.best.ids[i, j], "positive_score": self.best.scores[i, j]}


class Negatives:
    """Best rows of other labels in the window of each positive."""

    def __init__(self, anchors: Pack, positives: list[dict], k: int, low: int, high: int):
        self.anchors, n = anchors, len(anchors.ids)
        width = max([p["place"] for p in positives], default=0)
        self.ids, self.scores = np.zeros((n, width), np.int64), np.full((n, width), NONE)
        for p in positives:
            self.ids[p["anchor_no"], p["place"] - 1], self.scores[p["anchor_no"], p["place"] - 1] = p["positive_id"], p["positive_score"]
        self.least, self.most = _limits(self.scores, low, high)
        self.best = [Best(n, k) for _ in range(width)]

    def meet(self, rows: Pack) -> None:
        if not self.best:
            return
        # below its window and below what a full list already holds, nothing of a positive is asked for
        full = np.stack([b.scores[:, -1] for b in self.best], axis=1)
        least = np.where(self.least > self.most, np.iinfo(np.int64).max, np.maximum(self.least, full))
        wanted = self.anchors.labels[:, None] != rows.labels[None, :]
        a, b, found, mask = scores(self.anchors, rows, wanted, least.min(axis=1).astype(np.float64), self.most.max(axis=1).astype(np.float64))
        for n, best in enumerate(self.best):
            best.add(a, rows.ids[b], found, mask & (found >= least[a, n][:, None]) & (found <= self.most[a, n][:, None]))

    def results(self) -> Iterator[dict]:
        for n, best in enumerate(self.best):
            i, j = np.nonzero(best.scores != NONE)
            yield {"anchor_no": i, "anchor_id": self.anchors.ids[i], "place": np.full(len(i), n + 1), "positive_id": self.ids[i, n],
                   "positive_score": self.scores[i, n], "negative_id": best.ids[i, j], "negative_score": best.scores[i, j]}


def _met(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every anchor pack with every vector pack: vector packs are dealt to parts once, anchor packs (a row for some thousand vectors) copied to
    each part."""
    parts = max(1, -(-rows.count() // PART_PACKS))
    columns = ["part", "is_anchor", "pack", "dim", "ids", "labels", "vectors", "positives"]
    dealt = rows.withColumns({"part": F.pmod(F.xxhash64("pack"), F.lit(parts)).cast("int"), "is_anchor": F.lit(False),
                              "positives": F.lit(None).cast(anchors.schema["positives"].dataType)})
    copied = anchors.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "is_anchor": F.lit(True)})
    return dealt.select(columns).union(copied.select(columns)).repartition(parts, "part").sortWithinPartitions("part", "is_anchor", "pack")


def _best(found: DataFrame, group: list[str], score: str, name: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc(score), name)
    return found.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each row of ``vectors`` (vec_id, label, embedding) that fulfils ``anchors``, its ``positives`` nearest other rows of its label, and for
    each of these the ``negatives`` nearest rows of other labels whose score is between ``low`` and ``high`` percent of the positive's: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score. Fewer where there are fewer.

    Each component x counts as floor(256 x); scores are integer inner products, nearest first, ties to the smaller vec_id. Rows with a null
    vec_id, label or vector, a null or non-finite component, or so long a vector that a score might not fit a long (length of the floored
    vector from 2**31) take no part. Only vectors of equal dimension are compared; those without components score 0. Rows that repeat a vec_id
    are rows of their own, but not each other's positives. Other columns are not read. An empty table gives an empty result.
    """
    component = F.transform("embedding", lambda x: x.cast("double"))
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), component.alias("vector"), anchors.alias("anchor"))
    sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < LONGEST_COMPONENT))  # NaN is the largest value, so not below
    whole = F.transform("vector", lambda x: F.floor(x * 256).cast("double"))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    rows = plain.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(sound).withColumn(
        "vector", whole).filter(squares < LONGEST)
    n = plain.filter("anchor").count()
    chosen = rows.filter("anchor").repartition(max(1, -(-n // ANCHOR_ROWS)), F.xxhash64("vec_id"))
    row_packs = packs(rows.select("vec_id", "label", "vector"), PACK_ROWS)
    anchor_packs = packs(chosen.select("vec_id", "label", "vector"), ANCHOR_ROWS)
    no_positives = F.lit(None).cast("array<struct<anchor_no:int,place:int,positive_id:long,positive_score:long>>")
    near = _met(anchor_packs.withColumn("positives", no_positives), row_packs).mapInArrow(
        _search(lambda a, p: Positives(a, p, positives)), f"{PLACE}, positive_id long, positive_score long")
    best = store(_best(near, ["anchor_pack", "anchor_no"], "positive_score", "positive_id", positives, "place"))
    held = best.groupBy(F.col("anchor_pack").alias("pack")).agg(
        F.collect_list(F.struct("anchor_no", "place", "positive_id", "positive_score")).alias("positives"))  # as many as a pack has places
    hard = _met(anchor_packs.join(held, "pack"), row_packs).mapInArrow(
        _search(lambda a, p: Negatives(a, p, negatives, low, high)),
        f"{PLACE}, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    found = _best(hard, ["anchor_pack", "anchor_no", "place"], "negative_score", "negative_id", negatives, "rank")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
