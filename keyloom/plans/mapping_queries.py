"""Identifier mapping, attributes, biotypes and genome annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attributes as attr
from ..operators import genome, mapping
from ..sources import genome as genome_source
from ..session import spread
from . import relations as r
from .registry import query, rounded

_C = f"WITH {r.COUNTS} "
S = r.SAMPLES

# --- ID mapping: part -> supplier candidates scored by quantity; supplier -> nation name --------------------------------

_CAND = """cand AS (SELECT l_partkey AS from_id, l_suppkey AS to_id, sum(l_quantity) AS score, min(l_orderkey)::BIGINT AS "order"
  FROM lineitem GROUP BY 1, 2)"""
_BEST = """best AS (SELECT from_id, to_id FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY score DESC, to_id) AS rn
  FROM cand) WHERE rn = 1)"""


def _candidates(spark, d):
    return r.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id")).agg(
        F.sum("l_quantity").alias("score"), F.min("l_orderkey").alias("order"))


def _nations(spark, d):
    s, n = r.table(spark, d, "supplier"), r.table(spark, d, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("from_id"), F.col("n_name").alias("to_id"))


@query("apply_map_keep_unmapped", f"""{_C}, {_CAND}, {_BEST} SELECT coalesce(to_id, gene) AS gene, a_f, r_o FROM counts
  LEFT JOIN (SELECT * FROM best WHERE from_id IN (SELECT p_partkey FROM part WHERE p_size > 10)) ON from_id = gene""")
def _(spark, d):
    known = r.table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("from_id"))
    m = mapping.best_mapping(_candidates(spark, d)).join(known, "from_id", "left_semi")
    return mapping.apply_map(r.counts(spark, d).select("gene", "a_f", "r_o"), "gene", m)


@query("apply_map_remove_unmapped", f"""{_C}, {_CAND}, {_BEST} SELECT to_id AS gene, a_f, r_o FROM counts
  JOIN best ON from_id = gene WHERE gene IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def _(spark, d):
    known = r.table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("from_id"))
    m = mapping.best_mapping(_candidates(spark, d)).join(known, "from_id", "left_semi")
    return mapping.apply_map(r.counts(spark, d).select("gene", "a_f", "r_o"), "gene", m, True)


@query("translate_ids_two_hops", f"""{_C}, {_CAND}, {_BEST} SELECT n_name AS gene, a_f FROM counts JOIN best ON from_id = gene
  JOIN supplier ON s_suppkey = to_id JOIN nation ON n_nationkey = s_nationkey""")
def _(spark, d):
    second = _nations(spark, d).withColumn("score", F.lit(1.0))
    return mapping.translate_ids(r.counts(spark, d).select("gene", "a_f"), "gene", _candidates(spark, d), second, True)


@query("best_mapping_by_score", f"WITH {_CAND}, {_BEST} SELECT * FROM best")
def _(spark, d):
    return mapping.best_mapping(_candidates(spark, d))


@query("reverse_resolved_mapping", f"""WITH {_CAND}, n AS (SELECT from_id, count(*) AS n FROM cand GROUP BY 1),
  rev AS (SELECT s_suppkey AS to_id, s_acctbal AS score FROM supplier)
  SELECT from_id, to_id FROM (SELECT cand.from_id, cand.to_id, row_number() OVER (PARTITION BY cand.from_id
  ORDER BY rev.score DESC, cand.to_id) AS rn FROM cand LEFT JOIN rev USING (to_id)) WHERE rn = 1""")
def _(spark, d):
    reverse = r.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("from_id"), F.col("s_name").alias("to_id"), F.col("s_acctbal").alias("score"))
    return mapping.reverse_resolved(_candidates(spark, d), reverse)


_TAGGED = """tagged AS (SELECT c_custkey AS id, 'customer' AS id_type FROM customer UNION ALL SELECT p_partkey, 'part' FROM part
  UNION ALL SELECT s_suppkey, 'supplier' FROM supplier)"""


def _tagged(spark, d):
    parts = [r.table(spark, d, t).select(F.col(k).alias("id"), F.lit(t).alias("id_type")) for t, k in (
        ("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("id_type_counts", f"""{_C}, {_TAGGED} SELECT id_type, count(DISTINCT id)::BIGINT AS mapped FROM tagged
  WHERE id IN (SELECT gene FROM counts) GROUP BY 1""")
def _(spark, d):
    return mapping.count_by_id_type(r.counts(spark, d), "gene", _tagged(spark, d))


@query("best_id_type", f"""{_C}, {_TAGGED} SELECT id_type, count(DISTINCT id)::BIGINT AS mapped FROM tagged
  WHERE id IN (SELECT gene FROM counts) GROUP BY 1 ORDER BY mapped DESC, id_type LIMIT 1""")
def _(spark, d):
    return mapping.best_id_type(r.counts(spark, d), "gene", _tagged(spark, d))


# --- ortholog policies over the same candidates -----------------------------------------------------------------------

_LDO = _CAND + ", o AS (SELECT *, CASE WHEN score >= 60 THEN 'LDO' ELSE 'O' END AS ortholog FROM cand)"


def _ldo(spark, d):
    return _candidates(spark, d).withColumn("ortholog", F.when(F.col("score") >= 60, "LDO").otherwise("O"))


@query("orthologs_least_diverged_first", f"""WITH {_LDO} SELECT from_id, to_id FROM (SELECT *, row_number() OVER
  (PARTITION BY from_id ORDER BY ortholog = 'LDO' DESC, "order", to_id) AS rn FROM o) WHERE rn = 1""")
def _(spark, d):
    return mapping.orthologs_by_divergence(_ldo(spark, d))


@query("orthologs_least_diverged_last", f"""WITH {_LDO} SELECT from_id, to_id FROM (SELECT *, row_number() OVER
  (PARTITION BY from_id ORDER BY ortholog = 'LDO' DESC, "order" DESC, to_id DESC) AS rn FROM o) WHERE rn = 1""")
def _(spark, d):
    return mapping.orthologs_by_divergence(_ldo(spark, d), mode="last")


@query("orthologs_least_diverged_none", f"""WITH {_LDO}, k AS (SELECT *, rank() OVER (PARTITION BY from_id ORDER BY ortholog = 'LDO' DESC) AS rk,
  count(*) OVER (PARTITION BY from_id, ortholog) AS n FROM o) SELECT from_id, to_id FROM k WHERE rk = 1 AND n = 1""")
def _(spark, d):
    return mapping.orthologs_by_divergence(_ldo(spark, d), mode="none")


@query("orthologs_random", f"""WITH {_CAND} SELECT from_id, to_id FROM (SELECT *, row_number() OVER
  (PARTITION BY from_id ORDER BY md5('7:' || from_id || ':' || to_id), to_id) AS rn FROM cand) WHERE rn = 1""")
def _(spark, d):
    return mapping.resolve(_candidates(spark, d), "random", seed=7)


@query("orthologs_percent_identity", f"""WITH {_CAND} SELECT from_id, to_id FROM (SELECT *, row_number() OVER
  (PARTITION BY from_id ORDER BY score DESC, "order" DESC, to_id DESC) AS rn FROM cand) WHERE rn = 1""")
def _(spark, d):
    return mapping.orthologs_by_identity(_candidates(spark, d).withColumnRenamed("score", "perc_id"), mode="last")


_CONSISTENCY = f"""WITH {_CAND}, many AS (SELECT c_custkey AS from_id, n_name AS to_id, score/100 AS score
  FROM customer JOIN cand ON cand.from_id = c_custkey JOIN supplier ON s_suppkey = cand.to_id
  JOIN nation ON n_nationkey = s_nationkey WHERE score/100 >= 0.5) """


def _consistency(spark, d):
    cust = r.table(spark, d, "customer").select("c_custkey")
    to_protein = cust.select(F.col("c_custkey").alias("from_id"), F.col("c_custkey").alias("to_id"))
    pairs = _candidates(spark, d).select("from_id", "to_id", (F.col("score") / 100).alias("score"))
    return mapping.orthologs_by_consistency(cust, "c_custkey", to_protein, pairs, _nations(spark, d))


@query("orthologs_consistency_one_to_one", _CONSISTENCY + """SELECT from_id, to_id FROM (SELECT *, row_number() OVER
  (PARTITION BY from_id ORDER BY score DESC, to_id) AS rn FROM many) WHERE rn = 1""")
def _(spark, d):
    return _consistency(spark, d)[0]


@query("orthologs_consistency_one_to_many", _CONSISTENCY + "SELECT from_id, to_id, round(score,6) AS score FROM many")
def _(spark, d):
    return rounded(_consistency(spark, d)[1])


_GROUPS = """grp AS (SELECT o_orderkey, o_custkey, list_sort(list(DISTINCT l_partkey)) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY 1, 2)"""


def _ortholog_groups(spark, d):
    orders, li = r.table(spark, d, "orders"), r.table(spark, d, "lineitem")
    g = li.join(orders, li["l_orderkey"] == orders["o_orderkey"]).groupBy("o_orderkey", "o_custkey").agg(
        F.sort_array(F.collect_set("l_partkey")).alias("orthologs"))
    kind = F.when(F.size("orthologs") == 1, "Many-to-One").otherwise("Many-to-Many")
    return g.select(kind.alias("type"), "orthologs", F.array("o_orderkey", F.col("o_orderkey") + 1000000).alias("inparalogs"))


@query("orthologs_group_records", f"""WITH {_GROUPS}, f AS (SELECT o_orderkey AS from_id, parts FROM grp UNION ALL SELECT o_orderkey+1000000, parts FROM grp)
  SELECT from_id, parts[-1] AS to_id FROM f""")
def _(spark, d):
    return mapping.orthologs_from_groups(_ortholog_groups(spark, d), "last")[0]


@query("orthologs_group_pairs", f"""WITH {_GROUPS}, f AS (SELECT o_orderkey AS from_id, parts FROM grp UNION ALL SELECT o_orderkey+1000000, parts FROM grp)
  SELECT from_id, unnest(parts) AS to_id FROM f""")
def _(spark, d):
    return mapping.orthologs_from_groups(_ortholog_groups(spark, d))[1]


@query("paralog_pairs", f"""{_C}, {_CAND} SELECT from_id AS gene, to_id AS paralog FROM cand WHERE from_id IN (SELECT gene FROM counts)""")
def _(spark, d):
    return mapping.paralogs(r.counts(spark, d), "gene", _candidates(spark, d))


@query("paralog_pairs_closest", f"""{_C}, {_CAND} SELECT from_id AS gene, to_id AS paralog FROM (SELECT *, row_number() OVER
  (PARTITION BY from_id ORDER BY score DESC, to_id) AS rn FROM cand) WHERE rn = 1 AND from_id IN (SELECT gene FROM counts)""")
def _(spark, d):
    pairs = _candidates(spark, d).withColumnRenamed("score", "perc_id").drop("order")
    return mapping.paralogs(r.counts(spark, d), "gene", pairs, True)


@query("back_translate", f"""WITH {_CAND}, {_BEST} SELECT best.from_id, s_acctbal AS balance FROM best JOIN supplier ON s_suppkey = to_id""")
def _(spark, d):
    results = r.table(spark, d, "supplier").select(F.col("s_suppkey").alias("from_id"), F.col("s_acctbal").alias("balance"))
    return mapping.back_translate(results, mapping.best_mapping(_candidates(spark, d)))


@query("one_to_many_table", f"WITH {_GROUPS} SELECT o_orderkey AS gene, unnest(parts) AS ortholog FROM grp")
def _(spark, d):
    g = _ortholog_groups(spark, d).select(F.col("inparalogs")[0].alias("gene"), "orthologs")
    return mapping.explode_lists(g, "gene", "orthologs", "ortholog")


# --- attributes --------------------------------------------------------------------------------------------------------

_A = f"WITH {r.COUNTS}, {r.ATTRIBUTES} "


@query("filter_by_attribute_union", _A + "SELECT * FROM counts WHERE gene IN (SELECT gene FROM attrs WHERE attribute IN ('PROMO','Brand#12'))")
def _(spark, d):
    return attr.filter_by_attribute(r.counts(spark, d), "gene", r.attributes(spark, d), ["PROMO", "Brand#12"])


@query("filter_by_attribute_intersection", _A + """SELECT * FROM counts WHERE gene IN (SELECT gene FROM attrs
  WHERE attribute IN ('PROMO','size_2') GROUP BY gene HAVING count(DISTINCT attribute) = 2)""")
def _(spark, d):
    return attr.filter_by_attribute(r.counts(spark, d), "gene", r.attributes(spark, d), ["PROMO", "size_2"], "intersection")


@query("filter_by_attribute_opposite", _A + "SELECT * FROM counts WHERE gene NOT IN (SELECT gene FROM attrs WHERE attribute = 'ECONOMY')")
def _(spark, d):
    return attr.filter_by_attribute(r.counts(spark, d), "gene", r.attributes(spark, d), "ECONOMY", opposite=True)


@query("split_by_attribute", _A + "SELECT counts.*, attribute FROM counts JOIN attrs USING (gene) WHERE attribute IN ('PROMO','size_2','Brand#7')")
def _(spark, d):
    return attr.split_by_attribute(r.counts(spark, d), "gene", r.attributes(spark, d), ["PROMO", "size_2", "Brand#7"])


@query("attributes_from_wide_table", """SELECT 'p_size' AS attribute, p_partkey AS gene, p_size::DOUBLE AS value FROM part WHERE p_size > 25
  UNION ALL SELECT 'p_retailprice', p_partkey, p_retailprice FROM part""")
def _(spark, d):
    part = r.table(spark, d, "part").select(
        F.col("p_partkey").alias("gene"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"), "p_retailprice")
    return attr.attributes_to_long(part, "gene", with_value=True)


@query("filter_biotype_from_ref_table", f"{_C} SELECT * FROM counts WHERE gene IN (SELECT p_partkey FROM part WHERE p_type IN ('SMALL','LARGE'))")
def _(spark, d):
    return attr.filter_by_biotype(r.counts(spark, d), "gene", r.table(spark, d, "part"), ["SMALL", "LARGE"], "p_partkey", "p_type")


# --- genome annotation: lines are derived from part (genes), orders (transcripts) and lineitem (exons) ------------------

def _gtf_lines(spark, d):
    """Nine-field text lines, so that the parser is part of the query."""
    part = r.table(spark, d, "part")
    orders = spread(r.table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    li = spread(r.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"))
    q = F.lit('"')

    def pair(k, v):
        return F.concat(F.lit(f"{k} "), q, v.cast("string"), q, F.lit(";"))

    genes = part.select(
        F.struct(F.lit(0).alias("kind"), F.col("p_partkey").alias("a"), F.lit(0).alias("b")).alias("_row"),
        F.concat_ws("\t", F.lit("chr"), F.lit("src"), F.lit("gene"), F.lit("1"), F.col("p_size").cast("string"), F.lit("."),
                    F.lit("+"), F.lit("."), F.concat_ws(" ", pair("gene_id", F.concat("p_partkey", F.lit(".1"))),
                    pair("gene_version", F.lit("2")), pair("gene_name", F.col("p_name")), pair("gene_biotype", F.col("p_type")))).alias("value"))
    transcripts = orders.select(
        F.struct(F.lit(1).alias("kind"), F.col("o_orderkey").alias("a"), F.lit(0).alias("b")).alias("_row"),
        F.concat_ws("\t", F.lit("chr"), F.lit("src"), F.lit("transcript"), F.lit("1"), F.lit("2"), F.lit("."), F.lit("-"), F.lit("."),
                    F.concat_ws(" ", pair("gene_id", F.col("o_custkey")), pair("transcript_id", F.col("o_orderkey")))).alias("value"))
    start = F.datediff(F.col("l_shipdate"), F.lit("1990-01-01"))
    exons = li.select(
        F.struct(F.lit(2).alias("kind"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")).alias("_row"),
        F.concat_ws("\t", F.lit("chr"), F.lit("src"), F.lit("exon"), start.cast("string"),
                    (start + F.col("l_quantity").cast("int")).cast("string"), F.lit("."), F.lit("+"), F.lit("."),
                    pair("transcript_id", F.col("l_orderkey"))).alias("value"))
    return genes.unionByName(transcripts).unionByName(exons)


def _annotation(spark, d):
    return genome_source.parse_lines(_gtf_lines(spark, d), "gtf")


@query("gtf_parse", """SELECT feature, count(*)::BIGINT AS n, sum(s)::BIGINT AS start_sum, sum(e)::BIGINT AS end_sum, count(DISTINCT ident)::BIGINT AS ids FROM (
  SELECT 'gene' AS feature, 1 AS s, p_size AS e, p_partkey AS ident FROM part UNION ALL SELECT 'transcript', 1, 2, o_orderkey FROM orders
  UNION ALL SELECT 'exon', date_diff('day', DATE '1990-01-01', l_shipdate::DATE), date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity::INT,
  l_orderkey FROM lineitem) GROUP BY 1""")
def _(spark, d):
    ident = F.when(F.col("feature") == "gene", F.col("attrs")["gene_id"]).otherwise(F.col("attrs")["transcript_id"])
    return _annotation(spark, d).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("start").alias("start_sum"), F.sum("end").alias("end_sum"),
        F.countDistinct(ident).alias("ids"))


@query("gff3_parse", """SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS first_parent, 2::INTEGER AS parents FROM orders""")
def _(spark, d):
    lines = r.table(spark, d, "orders").select(F.concat_ws(
        "\t", F.lit("chr"), F.lit("src"), F.lit("mRNA"), F.lit("5"), F.lit("9"), F.lit("."), F.lit("+"), F.lit("."),
        F.concat(F.lit("ID="), "o_orderkey", F.lit(";Parent="), "o_custkey", F.lit(",x"), "o_custkey", F.lit(";"))).alias("value"))
    rows = genome_source.parse_lines(lines, "gff3")
    a = F.col("attrs")
    return rows.select(a["ID"][0].alias("id"), a["Parent"][0].alias("first_parent"), F.size(a["Parent"]).alias("parents"))


@query("gene_attribute_map", """SELECT p_partkey::VARCHAR || '.2' AS key, p_type AS value FROM part""")
def _(spark, d):
    return genome.gene_attribute_map(_annotation(spark, d), "gene_biotype", use_version=True, split_ids=True)


@query("gene_attribute_map_by_name", """SELECT p_name AS key, p_type AS value FROM (SELECT *, row_number() OVER
  (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""")
def _(spark, d):
    return genome.gene_attribute_map(_annotation(spark, d), "gene_biotype", use_name=True)


@query("filter_biotype_from_gtf", f"""{_C} SELECT gene::VARCHAR AS gene, a_f FROM counts WHERE gene IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')""")
def _(spark, d):
    c = r.counts(spark, d).select(F.col("gene").cast("string").alias("gene"), "a_f")
    ref = genome.biotype_map(_annotation(spark, d), c, "gene")
    return attr.filter_by_biotype(c, "gene", ref, "PROMO", "gene")


@query("transcripts_to_genes", "SELECT o_orderkey::VARCHAR AS transcript, o_custkey::VARCHAR AS gene FROM orders")
def _(spark, d):
    return genome.transcripts_to_genes(_annotation(spark, d))


_EXON = """ex AS (SELECT l_orderkey, o_custkey, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS s,
  date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity::INT AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  tr AS (SELECT o_custkey, l_orderkey, sum(e-s+1) AS n FROM ex GROUP BY 1, 2)"""


@query("feature_lengths_transcript", f"WITH {_EXON} SELECT l_orderkey::VARCHAR AS key, n::BIGINT AS length FROM tr")
def _(spark, d):
    return genome.feature_lengths(_annotation(spark, d), "transcript")


def _lengths_by(method, sql):
    @query(f"feature_lengths_{method}", f"WITH {_EXON} SELECT o_custkey::VARCHAR AS key, round({sql},6)::DOUBLE AS length FROM tr GROUP BY 1")
    def _(spark, d):
        return rounded(genome.feature_lengths(_annotation(spark, d), "gene", method))


for _method, _sql in (("mean", "avg(n)"), ("median", "quantile_cont(n,0.5)"), ("max", "max(n)"), ("min", "min(n)"),
                      ("geometric_mean", "exp(avg(ln(n)))")):
    _lengths_by(_method, _sql)

_UNION = """w AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv),
  isl AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e) AS g FROM w),
  u AS (SELECT k, g, max(e)-min(s)+1 AS n FROM isl GROUP BY 1, 2)"""


@query("feature_lengths_merged_exons", f"""WITH {_EXON}, iv AS (SELECT o_custkey AS k, s, e FROM ex), {_UNION}
  SELECT k::VARCHAR AS key, sum(n)::BIGINT AS length FROM u GROUP BY 1""")
def _(spark, d):
    return genome.feature_lengths(_annotation(spark, d), "gene", "merged_exons")


@query("interval_union_length", f"""WITH iv AS (SELECT o_custkey AS k, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS s,
  date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + 30 AS e FROM orders), {_UNION} SELECT k AS o_custkey, sum(n)::BIGINT AS length FROM u GROUP BY 1""")
def _(spark, d):
    start = F.datediff("o_orderdate", F.lit("1990-01-01"))
    iv = r.table(spark, d, "orders").select("o_custkey", start.alias("start"), (start + 30).alias("end"))
    return genome.union_lengths(iv, ["o_custkey"], tile=128)


_SUMS = ", ".join(f"sum(counts.{c}) AS {c}" for c in S)


@query("sum_transcripts_raw", f"{_C} SELECT p_brand AS gene, {_SUMS} FROM counts JOIN part ON p_partkey = counts.gene GROUP BY 1")
def _(spark, d):
    return _transcript_sums(spark, d, "raw")


@query("sum_transcripts_scaled_tpm", f"""{_C}, t AS (SELECT {", ".join(f"sum({c}) AS {c}" for c in S)} FROM counts) SELECT p_brand AS gene,
  {", ".join(f"round(sum(counts.{c}*1e6/t.{c})*(any_value(t.{c})/1e6),4) AS {c}" for c in S)} FROM counts JOIN part ON p_partkey = counts.gene, t GROUP BY 1""")
def _(spark, d):
    return rounded(_transcript_sums(spark, d, "scaled_tpm"), digits=4)


def _transcript_sums(spark, d, method):
    from ..operators.normalize import normalize_to_rpm
    m = r.matrix(spark, d)
    pairs = r.table(spark, d, "part").select(F.col("p_partkey").alias("transcript"), F.col("p_brand").alias("gene"))
    renamed = m.withColumnRenamed("gene", "target_id")
    return genome.sum_transcripts_to_genes(renamed, normalize_to_rpm(renamed, "target_id"), pairs, "target_id", S, method)
