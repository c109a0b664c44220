"""Ontology graphs as node and edge tables: levels, closures, propagation, subgraphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .skew import salted_join

PARENT_RELATIONS = ("is_a", "part_of")


def parent_edges(edges: DataFrame, relations: Sequence[str] = PARENT_RELATIONS) -> DataFrame:
    """(child, parent) pairs of the chosen relationship types."""
    return edges.filter(F.col("rel").isin(list(relations))).select("child", "parent").distinct()


def children(edges: DataFrame) -> DataFrame:
    """(parent, child): the reverse index."""
    return edges.select("parent", "child")


def resolve_alternatives(df: DataFrame, column: str, alternatives: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replace alternative IDs by main IDs and drop IDs the ontology does not know."""
    alt = alternatives.select(F.col("alt_id").alias(column), F.col("term").alias("__main"))
    main = df.join(alt, column, "left").withColumn(column, F.coalesce("__main", column)).drop("__main")
    return main.join(nodes.select(F.col("term").alias(column)).distinct(), column, "left_semi").select(*df.columns)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(term, level): 0 for roots, otherwise one more than the deepest parent (longest path from a root).

    Each round moves one step down from the whole frontier; the frontier never has more rows than the graph has
    nodes and is written out before the next round.
    """
    edges = checkpoint(edges.select("child", "parent").distinct())
    frontier = checkpoint(nodes.select("term").distinct().join(
        edges.select(F.col("child").alias("term")).distinct(), "term", "left_anti"))
    found, depth, limit = frontier.withColumn("level", F.lit(0)), 0, nodes.select("term").distinct().count()
    while depth < limit:  # the longest path has fewer steps than there are terms
        depth += 1
        frontier = checkpoint(edges.join(frontier.withColumnRenamed("term", "parent"), "parent").select(
            F.col("child").alias("term")).distinct())
        if frontier.isEmpty():
            return found.groupBy("term").agg(F.max("level").alias("level"))
        found = found.unionByName(frontier.withColumn("level", F.lit(depth)))
    if limit == 0:
        return found.groupBy("term").agg(F.max("level").alias("level"))
    raise ValueError("the ontology has a cycle")


def ancestors(edges: DataFrame) -> DataFrame:
    """(term, ancestor): transitive closure of the parent edges, without the term itself.

    Path doubling: after round k all paths of length up to 2^k are known, so a graph of depth d needs log2(d) rounds.
    """
    known = checkpoint(edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")).distinct())
    size = known.count()
    while True:
        step = known.select(F.col("term").alias("mid"), F.col("ancestor").alias("up"))
        longer = known.join(step, known["ancestor"] == step["mid"]).select("term", F.col("up").alias("ancestor"))
        known = checkpoint(known.unionByName(longer).distinct())
        grown = known.count()
        if grown == size:
            if not known.filter(F.col("term") == F.col("ancestor")).isEmpty():
                raise ValueError("the ontology has a cycle")
            return known
        size = grown


def propagate(annotations: DataFrame, closure: DataFrame, key: str = "key") -> DataFrame:
    """(term, key) pairs carried to every ancestor of the term, without repeats."""
    direct = annotations.select("term", key).distinct()
    lifted = salted_join(direct, closure, ["term"], [key]).select(F.col("ancestor").alias("term"), key)
    return direct.unionByName(lifted).distinct()


def level_order(nodes_with_levels: DataFrame, namespace: str | None = None) -> DataFrame:
    """Terms deepest first, by namespace when asked; IDs order a level."""
    rows = nodes_with_levels if namespace is None else nodes_with_levels.filter(F.col("namespace") == namespace)
    return rows.orderBy(F.desc("level"), "term")


def significant_subgraph(results: DataFrame, edges: DataFrame, closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges spanned by the significant result terms and all their ancestors.

    ``results`` is (term, significant, ...); nodes carry a flag for the significant ones.
    """
    hits = results.filter("significant").select("term").distinct()
    up = closure.join(hits, "term", "left_semi").select(F.col("ancestor").alias("term"))
    nodes = hits.unionByName(up).distinct().join(hits.withColumn("__hit", F.lit(True)), "term", "left").select(
        "term", F.coalesce("__hit", F.lit(False)).alias("significant"))
    inside = (edges.select("child", "parent").distinct()
              .join(nodes.select(F.col("term").alias("child")), "child", "left_semi")
              .join(nodes.select(F.col("term").alias("parent")), "parent", "left_semi"))
    return nodes, inside.select("child", "parent")


# --- pathway graphs ---------------------------------------------------------------------------------------------

def node_degrees(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, in_degree, out_degree, degree) of a directed graph."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col(source).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col(target).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"),
                                    F.count(F.lit(1)).alias("degree"))


def marked_pathway(nodes: DataFrame, members: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """Pathway nodes flagged when any of their member genes is marked. ``members`` is (entry, key)."""
    hit = members.join(marked.select(key).distinct(), key, "left_semi").select("entry").distinct()
    return nodes.join(hit.withColumn("__hit", F.lit(True)), "entry", "left").withColumn(
        "marked", F.coalesce("__hit", F.lit(False))).drop("__hit")
