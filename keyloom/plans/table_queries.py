"""Filters, sorting and set algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, sets, sorting
from . import relations as r
from .registry import query, rounded

_C = f"WITH {r.COUNTS} "
_D = f"WITH {r.DE} "
_ALL = ", ".join(r.SAMPLES)
_DE_ROUND = ('gene, round("baseMean",6) AS "baseMean", round("log2FoldChange",6)+0.0 AS "log2FoldChange", '
             'round(pvalue,6) AS pvalue, round(padj,6) AS padj')


@query("number_filter_gt", f"{_C} SELECT * FROM counts WHERE a_f > 130")
def _(spark, d):
    return filters.number_filters(r.counts(spark, d), "gene", "a_f", "greater than", 130)


@query("number_filter_abs_gt", f'{_D} SELECT {_DE_ROUND} FROM de WHERE abs("log2FoldChange") > 0.25')
def _(spark, d):
    return rounded(filters.number_filters(r.de_table(spark, d), "gene", "log2FoldChange", "abs_gt", 0.25))


@query("filter_opposite", f"{_C} SELECT * FROM counts WHERE gene NOT IN (SELECT gene FROM counts WHERE a_f > 130)")
def _(spark, d):
    return filters.number_filters(r.counts(spark, d), "gene", "a_f", ">", 130, opposite=True)


@query("filter_opposite_duplicate_keys", """SELECT l_partkey, count(*)::BIGINT AS n, sum(l_quantity) AS qty FROM lineitem
  WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.095) GROUP BY 1""")
def _(spark, d):
    li = r.table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_discount")
    kept = li.filter((F.col("l_quantity") > 49) & (F.col("l_discount") > 0.095))
    return filters.complement(li, kept, "l_partkey").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("text_filter_regex", "SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_matches(p_brand, '#1[0-4]$')")
def _(spark, d):
    part = r.table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return filters.text_filters(part, "p_partkey", "p_brand", "contains", "#1[0-4]$")


@query("text_filter_affixes", """SELECT p_partkey, p_name, p_type FROM part
  WHERE p_name LIKE 'red%' OR p_name LIKE '%ring' OR p_type = 'PROMO'""")
def _(spark, d):
    part = r.table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    hits = [filters.text_filters(part, "p_partkey", c, op, v) for c, op, v in (
        ("p_name", "starts with", "red"), ("p_name", "ends with", "ring"), ("p_type", "equals", "PROMO"))]
    return sets.union(hits, "p_partkey").join(part, "p_partkey")


@query("filter_missing_values", f"{_D} SELECT {_DE_ROUND} FROM de WHERE padj IS NOT NULL")
def _(spark, d):
    return rounded(filters.filter_missing_values(r.de_table(spark, d), "gene"))


@query("filter_missing_values_opposite", f"{_D} SELECT {_DE_ROUND} FROM de WHERE padj IS NULL")
def _(spark, d):
    return rounded(filters.filter_missing_values(r.de_table(spark, d), "gene", "padj", opposite=True))


@query("filter_by_row_name", f"{_C} SELECT * FROM counts WHERE gene NOT IN (SELECT p_partkey FROM part WHERE p_type='PROMO')")
def _(spark, d):
    names = r.table(spark, d, "part").filter("p_type = 'PROMO'").select("p_partkey")
    return filters.filter_by_row_name(r.counts(spark, d), "gene", names)


_ROW = "l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice"


@query("filter_duplicate_ids_first", f"""SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_ROW}) AS rn FROM lineitem) WHERE rn = 1""")
def _(spark, d):
    return _dedupe(spark, d, "first")


@query("filter_duplicate_ids_last", f"""SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC,
  l_quantity DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""")
def _(spark, d):
    return _dedupe(spark, d, "last")


def _dedupe(spark, d, policy):
    order = _ROW.split(", ")
    li = r.table(spark, d, "lineitem").select("l_partkey", *order)
    return filters.filter_duplicate_ids(li, "l_partkey", order, policy).select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")


@query("filter_duplicate_ids_neither", """SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders
  GROUP BY o_custkey HAVING count(*) = 1""")
def _(spark, d):
    orders = r.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return filters.filter_duplicate_ids(orders, "o_custkey", ["o_orderkey"], "neither")


@query("drop_columns", f"{_C} SELECT gene, a_f, n_f, r_f FROM counts")
def _(spark, d):
    return filters.drop_columns(r.counts(spark, d), r.O_SAMPLES)


@query("filter_percentile_linear", f"{_C} SELECT * FROM counts WHERE a_f <= (SELECT quantile_cont(a_f, 0.73) FROM counts)")
def _(spark, d):
    return filters.filter_percentile(r.counts(spark, d), "gene", 0.73, "a_f")


@query("filter_percentile_nearest", f"""{_C}, o AS (SELECT a_f, row_number() OVER (ORDER BY a_f) - 1 AS i,
  count(*) OVER () AS n FROM counts) SELECT * FROM counts
  WHERE a_f <= (SELECT max(a_f) FROM o WHERE i = floor((n-1)*0.31+0.5))""")
def _(spark, d):
    return filters.filter_percentile(r.counts(spark, d), "gene", 0.31, "a_f", "nearest")


@query("split_by_percentile", f"""{_C}, c AS (SELECT quantile_cont(n_o, 0.5) AS q FROM counts)
  SELECT gene, n_o, CASE WHEN n_o <= q THEN 'below' ELSE 'above' END AS part FROM counts, c""")
def _(spark, d):
    below, above = filters.split_by_percentile(r.counts(spark, d).select("gene", "n_o"), "gene", 0.5, "n_o")
    return below.withColumn("part", F.lit("below")).unionByName(above.withColumn("part", F.lit("above")))


@query("filter_significant", f"{_D} SELECT {_DE_ROUND} FROM de WHERE padj <= 0.1")
def _(spark, d):
    return rounded(filters.filter_significant(r.de_table(spark, d), "gene", 0.1))


@query("filter_significant_opposite", f"{_D} SELECT {_DE_ROUND} FROM de WHERE padj > 0.1 OR padj IS NULL")
def _(spark, d):
    return rounded(filters.filter_significant(r.de_table(spark, d), "gene", 0.1, opposite=True))


@query("filter_abs_log2_fold_change", f'{_D} SELECT {_DE_ROUND} FROM de WHERE abs("log2FoldChange") >= 0.2')
def _(spark, d):
    return rounded(filters.filter_abs_log2_fold_change(r.de_table(spark, d), "gene", 0.2))


@query("filter_abs_log2_fold_change_fc", f"WITH {r.FC} SELECT gene, round(fc,6) AS fc FROM fcs WHERE abs(log2(fc)) >= 0.2")
def _(spark, d):
    return rounded(filters.filter_abs_log2_fold_change(r.fold_changes(spark, d), "gene", 0.2, "fc", True))


@query("split_fold_change_direction", f"""{_D} SELECT gene, CASE WHEN "log2FoldChange" > 0 THEN 'pos' ELSE 'neg' END AS direction
  FROM de WHERE "log2FoldChange" <> 0""")
def _(spark, d):
    pos, neg = filters.split_fold_change_direction(r.de_table(spark, d), "gene")
    return pos.select("gene", F.lit("pos").alias("direction")).unionByName(
        neg.select("gene", F.lit("neg").alias("direction")))


@query("filter_fold_change_direction_fc", f"WITH {r.FC} SELECT gene, round(fc,6) AS fc FROM fcs WHERE fc < 1")
def _(spark, d):
    return rounded(filters.filter_fold_change_direction(r.fold_changes(spark, d), "gene", "neg", "fc", True))


@query("volcano", f"""{_D} SELECT gene, CASE WHEN padj <= 1e-300 THEN 300.0::DOUBLE ELSE round(-log10(padj),6)+0.0 END AS neg_log10_padj,
  CASE WHEN padj <= 0.1 AND "log2FoldChange" >= 0.2 THEN 'up' WHEN padj <= 0.1 AND "log2FoldChange" <= -0.2 THEN 'down'
  ELSE 'neutral' END AS direction FROM de""")
def _(spark, d):
    drawn = filters.volcano(r.de_table(spark, d), 0.1, 0.2)  # 300 stands for all that is higher, where exp() has few digits left
    return rounded(drawn.select("gene", F.when(F.col("neg_log10_padj") < 300, F.col("neg_log10_padj")).when(
        F.col("neg_log10_padj").isNotNull(), 300.0).alias("neg_log10_padj"), "direction"))


@query("filter_low_reads", f"{_C} SELECT * FROM counts WHERE " + " + ".join(
    f"CASE WHEN {s} >= 120 THEN 1 ELSE 0 END" for s in r.SAMPLES) + " >= 4")
def _(spark, d):
    return filters.filter_low_reads(r.counts(spark, d), "gene", 120, 4)


@query("split_by_reads", f"{_C} SELECT gene, CASE WHEN greatest({_ALL}) >= 200 THEN 'high' ELSE 'low' END AS part FROM counts")
def _(spark, d):
    high, low = filters.split_by_reads(r.counts(spark, d), "gene", 200)
    return high.select("gene", F.lit("high").alias("part")).unionByName(low.select("gene", F.lit("low").alias("part")))


@query("filter_by_row_sum", f"{_C} SELECT * FROM counts WHERE {'+'.join(r.SAMPLES)} >= 800")
def _(spark, d):
    return filters.filter_by_row_sum(r.counts(spark, d), "gene", 800)


@query("key_tests", f"{_C} SELECT count(*)::BIGINT AS rows, 6::BIGINT AS columns, true AS unique_key FROM counts")
def _(spark, d):
    c = r.counts(spark, d)
    per_key = c.groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("rows"), F.lit(len(c.columns) - 1).cast("long").alias("columns"),
                       (F.max("n") == 1).alias("unique_key"))


# --- sorting ---------------------------------------------------------------------------------------------------

@query("sort_mixed", f"""{_D} SELECT gene, row_number() OVER (ORDER BY padj DESC NULLS LAST, gene) AS position FROM de""")
def _(spark, d):
    from ..operators.ranking import row_numbers
    de = r.de_table(spark, d).select("gene", "padj")
    return row_numbers(de, [], [F.col("padj").desc_nulls_last(), F.col("gene")], "position").select("gene", "position")


@query("filter_top_n", f"{_D} SELECT {_DE_ROUND} FROM (SELECT * FROM de ORDER BY pvalue ASC NULLS LAST, gene LIMIT 100)")
def _(spark, d):
    return rounded(sorting.filter_top_n(r.de_table(spark, d), "gene", "pvalue", 100))


@query("filter_top_n_multi", f"{_C} SELECT * FROM counts ORDER BY a_f DESC NULLS FIRST, a_o ASC NULLS FIRST, gene LIMIT 37")
def _(spark, d):
    return sorting.filter_top_n(r.counts(spark, d), "gene", ["a_f", "a_o"], 37, [False, True], "first")


@query("filter_top_n_opposite", f"""{_C} SELECT * FROM counts WHERE gene NOT IN
  (SELECT gene FROM counts ORDER BY a_f, gene LIMIT 500)""")
def _(spark, d):
    return sorting.filter_top_n(r.counts(spark, d), "gene", "a_f", 500, opposite=True)


@query("head_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def _(spark, d):
    return sorting.head(r.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])


@query("tail_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def _(spark, d):
    return sorting.tail(r.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 7)


# --- set algebra -------------------------------------------------------------------------------------------------

_SETS = f"""WITH {r.COUNTS}, a AS (SELECT gene FROM counts WHERE a_f > 120), b AS (SELECT gene FROM counts WHERE a_o > 120),
  c AS (SELECT DISTINCT p_partkey AS gene FROM part WHERE p_size > 20) """


def _three(spark, d):
    c = r.counts(spark, d)
    return {"a": c.filter("a_f > 120").select("gene"), "b": c.filter("a_o > 120").select("gene"),
            "c": r.table(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("gene"))}


@query("set_union", _SETS + "SELECT gene FROM a UNION SELECT gene FROM b UNION SELECT gene FROM c")
def _(spark, d):
    return sets.union(list(_three(spark, d).values()), "gene")


@query("set_intersection", _SETS + "SELECT gene FROM a INTERSECT SELECT gene FROM b INTERSECT SELECT gene FROM c")
def _(spark, d):
    return sets.intersection(list(_three(spark, d).values()), "gene")


@query("set_intersection_rows", _SETS + "SELECT counts.* FROM counts JOIN c USING (gene) JOIN b USING (gene)")
def _(spark, d):
    s = _three(spark, d)
    return sets.intersect_rows(r.counts(spark, d), [s["c"], s["b"]], "gene")


@query("set_difference", _SETS + "SELECT gene FROM a EXCEPT SELECT gene FROM b EXCEPT SELECT gene FROM c")
def _(spark, d):
    a, *others = _three(spark, d).values()
    return sets.difference(a, others, "gene")


@query("set_difference_rows", _SETS + "SELECT * FROM counts WHERE gene NOT IN (SELECT gene FROM a)")
def _(spark, d):
    return sets.difference_rows(r.counts(spark, d), [_three(spark, d)["a"]], "gene")


@query("set_symmetric_difference", _SETS + """(SELECT gene FROM a EXCEPT SELECT gene FROM b)
  UNION (SELECT gene FROM b EXCEPT SELECT gene FROM a)""")
def _(spark, d):
    s = _three(spark, d)
    return sets.symmetric_difference([s["a"], s["b"]], "gene")


@query("set_majority_vote", _SETS + """SELECT gene FROM (SELECT gene FROM a UNION ALL SELECT gene FROM b
  UNION ALL SELECT gene FROM c) GROUP BY gene HAVING count(*) >= 2""")
def _(spark, d):
    return sets.majority_vote_intersection(list(_three(spark, d).values()), "gene", 0.6)


_PATTERNS = """, m AS (SELECT gene, sum(bit)::BIGINT AS mask FROM (SELECT gene, 1 AS bit FROM a UNION ALL
  SELECT gene, 2 FROM b UNION ALL SELECT gene, 4 FROM c) GROUP BY gene),
  p AS (SELECT * FROM (VALUES (1,'a'),(2,'b'),(4,'c'),(3,'a;b'),(5,'a;c'),(6,'b;c'),(7,'a;b;c')) t(mask, sets))
  SELECT p.mask::BIGINT AS mask, p.sets, count(m.gene)::BIGINT AS size FROM p LEFT JOIN m ON p.mask = m.mask GROUP BY 1, 2"""


@query("upset_exclusive_intersections", _SETS.rstrip() + _PATTERNS)
def _(spark, d):
    return sets.exclusive_intersections(_three(spark, d), "gene")


@query("venn_regions", _SETS.rstrip() + _PATTERNS)
def _(spark, d):
    return sets.venn(_three(spark, d), "gene")


@query("concatenate", f"""{_C} SELECT * FROM counts WHERE a_f > 140 UNION ALL SELECT * FROM counts WHERE a_f < 90""")
def _(spark, d):
    c = r.counts(spark, d)
    return sets.concatenate(c.filter("a_f > 140"), c.filter("a_f < 90"), "gene")


@query("index_string", """SELECT string_agg(p_brand, chr(10) ORDER BY p_brand) AS ids FROM (SELECT DISTINCT p_brand FROM part)""")
def _(spark, d):
    return sets.to_text(r.table(spark, d, "part"), "p_brand")
