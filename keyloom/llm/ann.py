"""Nearest neighbours by largest inner product in a hash-prefix forest.

Each tree hashes a vector to a long string of sign bits; its sorted array of strings is stored in leaves of a common prefix, cut
into chunks of bounded size. A query descends to its leaf in every tree, then all trees ascend together, one bit of the
prefix at a time, taking in the sibling subtrees, until so long a prefix would have caught its k-th neighbour
with the wanted probability in one of the trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

TREES = 16
#: Bits of a hash string.
BITS = 32
#: Vectors of a leaf that one task scores at once.
LEAF = 4096


def sign_planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, trees * BITS))


def hash_strings(vectors: np.ndarray, radius: float, trees: int, seed: int, query: bool) -> np.ndarray:
    """(rows, trees): strings as numbers, first bit highest. Data vectors get one more component that brings all to length ``radius``,
    queries a zero, so that the angle between them falls as the inner product grows."""
    extra = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(radius ** 2 - (vectors ** 2).sum(axis=1), 0.0))
    signs = np.column_stack([vectors, extra]) @ sign_planes(vectors.shape[1], trees, seed) > 0
    return signs.reshape(len(vectors), trees, BITS) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def recall_at(level: np.ndarray, cosine: np.ndarray, trees: int) -> np.ndarray:
    """Chance that a vector at this cosine shares ``level`` bits with the query in at least one tree."""
    same = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return 1 - (1 - same ** level) ** trees


def best_rows(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the k best (places, scores), ties to the smaller id. Scores of chosen rows are summed anew in one fixed order, so
    that equal vectors get equal scores."""
    rough = queries @ vectors.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    out = []
    for q, scores in zip(queries, rough):
        top = np.arange(len(ids)) if len(ids) <= k else np.argpartition(-scores, k - 1)[:k]
        edge = scores[top].min()
        if len(ids) > k and np.isfinite(edge):
            top = np.flatnonzero(scores >= edge - 1e-9 * max(1.0, abs(edge)))
        top = top[np.isfinite(scores[top])]
        exact = (vectors[top] * q).sum(axis=1)
        order = np.lexsort((ids[top], -exact))[:k]
        out.append((top[order], exact[order]))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.9, trees: int = TREES, leaf: int = LEAF,
            seed: int = 7) -> DataFrame:
    """The k nearest of ``vectors`` (vec_id, embedding) to each of ``queries`` (vec_id, embedding): query_id, rank, vec_id, score.

    Nearness is the inner product in double precision. A candidate with the query's own vec_id is left out; ties go to the smaller vec_id. The
    ascent stops where the k-th neighbour found so far has been caught with probability ``recall`` at least; as that one is never
    nearer than the true one, the rule errs to the safe side. Vectors that are null, zero, or hold null or non-finite components
    take no part. Only vectors of as many components as the query's are its candidates, so a longer or shorter row
    takes no other one out. A query with fewer than k candidates gets all. Rows that repeat a vec_id are candidates of their own. Of exactly
    equal vectors only the k + 1 smallest ids, with k rows each, are indexed, as no others can be in a result. Empty tables give an empty result.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.transform("embedding", lambda x: x.cast("double"))
        ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(
            ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
        return df.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull())

    same = Window.partitionBy("v").orderBy("vec_id")
    ids = clean(vectors).withColumn("__n", F.dense_rank().over(same)).filter(F.col("__n") <= k + 1)
    own = Window.partitionBy("v", "vec_id").orderBy("vec_id")
    points = store(ids.withColumn("__n", F.row_number().over(own)).filter(F.col("__n") <= k).drop("__n").withColumn(
        "row", F.monotonically_increasing_id()))
    length2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.max(length2).alias("most")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    radius = float(np.sqrt(facts["most"]))
    depth = max(0, int(np.ceil(np.log2(facts["n"] / leaf))))

    def hashed(query: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, rows in batch.groupby(batch["v"].map(len), sort=False):
                    strings = hash_strings(np.stack(rows["v"].to_numpy()), radius, trees, seed, query)
                    yield pd.DataFrame({"row": rows["row"], "vec_id": rows["vec_id"], "v": rows["v"], "prefixes": list(strings >> (BITS - depth))})
        return run

    def in_leaves(df: DataFrame, query: bool) -> DataFrame:
        return df.mapInPandas(hashed(query), "row long, vec_id long, v array<double>, prefixes array<long>")

    def tree_number(place: str, dim: Column) -> Column:
        return (F.col(place) + dim * trees).cast("int")  # each number of components has trees of its own

    leaves = in_leaves(points, False).select("row", "vec_id", "v", F.posexplode("prefixes").alias("tree", "prefix")).withColumn(
        "tree", tree_number("tree", F.size("v")))
    full = store(leaves.groupBy("tree", "prefix").agg(F.ceil(F.count(F.lit(1)) / (2 * leaf)).cast("int").alias("chunks")))
    asked = store(in_leaves(clean(queries).withColumn("row", F.monotonically_increasing_id()), True).withColumnRenamed("row", "uid").withColumn(
        "dim", F.size("v")))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, rows in whole_groups(batches):
            at = rows["query"].to_numpy()
            if at.all() or not at.any():
                continue
            asking, data = rows[at], rows[~at]
            found = best_rows(np.stack(asking["v"].to_numpy()), data["vec_id"].to_numpy(), np.stack(data["v"].to_numpy()),
                              asking["vec_id"].to_numpy(), k)
            yield pd.DataFrame({
                "uid": np.repeat(asking["uid"].to_numpy(), [len(f[0]) for f in found]),
                **{c: data[c].to_numpy()[np.concatenate([f[0] for f in found])] for c in ("row", "vec_id")},
                "score": np.concatenate([f[1] for f in found])})

    best, level, todo = None, depth, asked.select("uid", "dim", F.posexplode("prefixes").alias("tree", "prefix")).select(
        "uid", tree_number("tree", F.col("dim")).alias("tree"), "prefix")
    while True:
        visits = todo.join(full, ["tree", "prefix"]).select(
            "uid", "tree", "prefix", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        met = visits.join(asked.select("uid", "vec_id", "v"), "uid").select("tree", "prefix", "chunk", F.lit(True).alias("query"), "uid",
                                                                           F.lit(0).cast("long").alias("row"), "vec_id", "v")
        data = leaves.join(full, ["tree", "prefix"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).join(
            visits.select("tree", "prefix", "chunk").distinct(), ["tree", "prefix", "chunk"], "left_semi").select(
            "tree", "prefix", "chunk", F.lit(False).alias("query"), F.lit(0).cast("long").alias("uid"), "row", "vec_id", "v")
        scored = met.union(data).repartition("tree", "prefix", "chunk").sortWithinPartitions("tree", "prefix", "chunk", "query").mapInPandas(
            score, "uid long, row long, vec_id long, score double")
        scored = scored if best is None else scored.union(best)
        place = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id", "row")
        best = store(scored.distinct().withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).drop("rank"))
        if level == 0:
            break
        kth = best.groupBy("uid").agg(F.min("score").alias("__kth"), F.count(F.lit(1)).alias("__found"))
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        cosine = F.col("__kth") / (length * radius)
        agree = 1 - F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))) / np.pi
        caught = 1 - F.pow(1 - F.pow(agree, F.lit(level)), F.lit(trees))
        open_ = asked.join(kth, "uid", "left").filter(
            (F.coalesce("__found", F.lit(0)) < k) | (caught < recall)).select("uid", "dim", "prefixes")
        level -= 1
        span = depth - level - 1  # the sibling subtree at this level has 2 ** span leaves
        sibling = F.shiftright("own", span).bitwiseXOR(F.lit(1).cast("long"))
        todo = store(open_.select("uid", "dim", F.posexplode("prefixes").alias("tree", "own")).select(
            "uid", tree_number("tree", F.col("dim")).alias("tree"), F.explode(F.sequence(F.shiftleft(sibling, span), F.shiftleft(sibling + 1, span) - 1)).alias("prefix")))
        if todo.isEmpty():
            break
    place = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id", "row")
    return best.withColumn("rank", F.row_number().over(place)).join(
        asked.select("uid", F.col("vec_id").alias("query_id")), "uid").select("query_id", "rank", "vec_id", "score")


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The runs of rows with equal (tree, prefix, chunk) of a sorted partition; a run is bounded by the size of a leaf chunk and its queries."""
    held, key = [], None
    for batch in batches:
        for own, rows in batch.groupby(["tree", "prefix", "chunk"], sort=False):
            if held and own != key:
                yield key, pd.concat(held)
                held = []
            key = own
            held.append(rows)
    if held:
        yield key, pd.concat(held)
