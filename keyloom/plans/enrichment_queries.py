"""Enrichment tests, multiple-testing correction and ontology operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import attributes as attr
from ..operators import enrichment as en
from ..operators import ontology as onto
from ..operators import ranking
from ..session import checkpoint, stored
from . import relations as r
from .registry import query, rounded

_BASE = f"WITH RECURSIVE {r.COUNTS}, {r.TARGETS}, {r.ATTRIBUTES}"

# (set, attribute, N, n, K, k) in SQL over a relation ann(attribute, gene)
_PARAMS = """bg AS (SELECT DISTINCT gene FROM ann), tg AS (SELECT * FROM targets WHERE gene IN (SELECT gene FROM bg)),
  nn AS (SELECT count(*) AS population FROM bg), ns AS (SELECT set_id, count(*) AS draws FROM tg GROUP BY 1),
  ks AS (SELECT attribute, count(DISTINCT gene) AS successes FROM ann GROUP BY 1),
  hs AS (SELECT set_id, attribute, count(DISTINCT gene) AS hits FROM ann JOIN tg USING (gene) GROUP BY 1, 2),
  prm AS (SELECT ns.set_id, ks.attribute, population, draws, successes, coalesce(hits,0) AS hits
    FROM ns CROSS JOIN ks CROSS JOIN nn LEFT JOIN hs ON hs.set_id = ns.set_id AND hs.attribute = ks.attribute)"""
_LPMF = ("exp(lgamma(s+1)-lgamma(i+1)-lgamma(s-i+1)+lgamma(m-s+1)-lgamma(dr-i+1)-lgamma(m-s-dr+i+1)"
         "-lgamma(m+1)+lgamma(dr+1)+lgamma(m-dr+1))")


def _pmf(source, suffix=""):
    return f"""sup{suffix} AS (SELECT *, successes::DOUBLE AS s, draws::DOUBLE AS dr, population::DOUBLE AS m,
  unnest(range(greatest(0, draws+successes-population)::BIGINT, least(draws, successes)::BIGINT+1))::DOUBLE AS i FROM {source}),
  pmf{suffix} AS (SELECT *, {_LPMF} AS p FROM sup{suffix})"""


_FISHER = _pmf("prm") + """, obsp AS (SELECT set_id, attribute, p AS po FROM pmf WHERE i = hits),
  tested AS (SELECT pmf.set_id, pmf.attribute, any_value(population) AS population, any_value(draws) AS draws, any_value(successes) AS successes,
  any_value(hits) AS hits, least(1.0, sum(CASE WHEN p <= po*(1+1e-7) THEN p ELSE 0 END)) AS pval FROM pmf JOIN obsp USING (set_id, attribute) GROUP BY 1, 2)"""
_HYPER = _pmf("prm") + """, tested AS (SELECT set_id, attribute, any_value(population) AS population, any_value(draws) AS draws, any_value(successes) AS successes,
  any_value(hits) AS hits, least(1.0, sum(CASE WHEN hits*population < successes*draws THEN CASE WHEN i <= hits THEN p ELSE 0 END
  WHEN i >= hits THEN p ELSE 0 END)) AS pval FROM pmf GROUP BY 1, 2)"""


def _fdr(source="tested", group="set_id", extra="1"):
    return f"""rk AS (SELECT *, pval * count(*) OVER (PARTITION BY {group}) / rank_last * {extra} AS raw FROM (
    SELECT *, count(*) OVER (PARTITION BY {group} ORDER BY pval) AS rank_last FROM {source})),
  adj AS (SELECT *, least(1.0, min(raw) OVER (PARTITION BY {group} ORDER BY pval DESC)) AS padj FROM rk)"""


_BY = "(SELECT sum(1.0::DOUBLE/j) FROM range(1, 1 + (SELECT count(DISTINCT attribute) FROM tested)) t(j))"
_OUT = """SELECT set_id, attribute AS name, draws::BIGINT AS samples, hits::BIGINT AS obs, round(draws*successes/population::DOUBLE,6) AS exp,
  round(CASE WHEN hits > 0 THEN log2((hits/draws::DOUBLE)/(successes/population::DOUBLE)) ELSE '-inf'::DOUBLE END,6)+0.0 AS log2_fold_enrichment,
  round(pval,8) AS pval, round(padj,8) AS padj, padj <= 0.05 AS significant"""


def _round(df):
    small = rounded(df, ["exp", "log2_fold_enrichment"])
    return rounded(small, ["pval", "padj"], 8)


@query("set_parameters", f"""{_BASE}, ann AS (SELECT * FROM attrs), {_PARAMS} SELECT set_id, attribute, population::BIGINT AS population,
  draws::BIGINT AS draws, successes::BIGINT AS successes, hits::BIGINT AS hits FROM prm""")
def _(spark, d):
    a = r.attributes(spark, d)
    scope = en.resolve_background(a, "gene")
    return en.set_parameters(a, en.resolve_targets(r.target_sets(spark, d), "gene", scope), "gene", scope)


@query("enrichment_fisher", f"{_BASE}, ann AS (SELECT * FROM attrs), {_PARAMS}, {_FISHER}, {_fdr()} {_OUT} FROM adj")
def _(spark, d):
    return _round(en.enrichment(r.attributes(spark, d), r.target_sets(spark, d), "gene"))


@query("enrichment_hypergeometric_background", f"""{_BASE}, ann AS (SELECT * FROM attrs WHERE gene IN (SELECT gene FROM counts WHERE a_f > 90)),
  {_PARAMS}, {_HYPER}, {_fdr()} {_OUT} FROM adj""")
def _(spark, d):
    bg = r.counts(spark, d).filter("a_f > 90").select("gene")
    return _round(en.enrichment(r.attributes(spark, d), r.target_sets(spark, d), "gene", bg, "hypergeometric"))


@query("enrichment_permutation", f"""{_BASE}, ann AS (SELECT * FROM attrs), {_PARAMS}, {_pmf("prm")}, tails AS (SELECT set_id, attribute, any_value(draws) AS draws, any_value(hits) AS hits,
  sum(CASE WHEN i >= hits THEN p ELSE 0 END) AS high, sum(CASE WHEN i <= hits THEN p ELSE 0 END) AS low, any_value(population)::DOUBLE AS population, any_value(successes)::DOUBLE AS successes FROM pmf GROUP BY 1, 2)
  SELECT set_id, attribute AS name, hits::BIGINT AS obs, round(CASE WHEN hits*population >= successes*draws AND hits > 0 THEN high ELSE low END, 6)+0.0 AS tail, true AS near FROM tails""")
def _(spark, d):
    """The drawn p-values against the exact tails they estimate: within five standard errors and the step of one draw."""
    drawn = en.enrichment(r.attributes(spark, d), r.target_sets(spark, d), "gene", test="randomization", seed=3)
    en.register_test("one_tail", lambda n, k, s, x: stats.hypergeom_sf(x - 1, n, s, k) if x * n >= s * k and x > 0 else stats.hypergeom_cdf(x, n, s, k))
    exact = en.enrichment(r.attributes(spark, d), r.target_sets(spark, d), "gene", test="one_tail").select("set_id", "name", F.col("pval").alias("tail"))
    error = 5 * F.sqrt(F.col("tail") * (1 - F.least("tail", F.lit(1.0))) / 10000) + 2 / 10001
    return rounded(drawn.join(exact, ["set_id", "name"]).select("set_id", "name", "obs", "tail", (F.abs(F.col("pval") - F.col("tail")) <= error).alias("near")))


@query("enrichment_significant_only", f"{_BASE}, ann AS (SELECT * FROM attrs), {_PARAMS}, {_HYPER}, {_fdr()} {_OUT.replace('0.05', '0.5')} FROM adj WHERE padj <= 0.5")
def _(spark, d):
    return _round(en.enrichment(r.attributes(spark, d), r.target_sets(spark, d), "gene", test="hypergeometric", alpha=0.5,
                                return_nonsignificant=False))


@query("enrichment_selected_attributes", f"{_BASE}, ann AS (SELECT * FROM attrs WHERE attribute IN ('PROMO','SMALL','size_1','Brand#3')), {_PARAMS}, {_FISHER}, {_fdr()} {_OUT} FROM adj")
def _(spark, d):
    chosen = attr.select_attributes(r.attributes(spark, d), ["PROMO", "SMALL", "size_1", "Brand#3"])
    return _round(en.enrichment(chosen, r.target_sets(spark, d), "gene"))


@query("pathway_enrichment", f"""{_BASE}, path AS (SELECT DISTINCT l_partkey AS gene, n_name AS attribute FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey), ann AS (SELECT attribute, gene FROM path), {_PARAMS}, {_FISHER}, {_fdr(extra=_BY)} {_OUT}, r_name AS pathway_name
  FROM adj JOIN nation ON n_name = attribute JOIN region ON r_regionkey = n_regionkey""")
def _(spark, d):
    li, s, n, reg = (r.table(spark, d, t) for t in ("lineitem", "supplier", "nation", "region"))
    names = n.join(reg, n["n_regionkey"] == reg["r_regionkey"]).select(F.col("n_name").alias("pathway"), F.col("r_name").alias("name"))
    by_nation = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", F.col("n_name").alias("pathway"))
    members = li.join(by_nation, li["l_suppkey"] == by_nation["s_suppkey"]).select(
        "pathway", F.col("l_partkey").alias("gene")).distinct()
    return _round(en.pathway_enrichment(members, names, r.target_sets(spark, d), "gene"))


# --- numeric attributes ------------------------------------------------------------------------------------------------

_NUM = """num AS (SELECT 'p_size' AS attribute, p_partkey AS gene, p_size::DOUBLE AS value FROM part
  UNION ALL SELECT 'p_retailprice', p_partkey, p_retailprice FROM part)"""
_MIDDLE = """mid AS (SELECT attribute, avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM num GROUP BY 1),
  tv AS (SELECT set_id, attribute, value, mean, median FROM num JOIN targets USING (gene) JOIN mid USING (attribute))"""


def _numeric(spark, d):
    part = r.table(spark, d, "part").withColumnRenamed("p_partkey", "gene")
    return attr.attributes_to_long(part, "gene", ["p_size", "p_retailprice"], with_value=True)


@query("numeric_enrichment_sign_test", f"""{_BASE}, {_NUM}, {_MIDDLE}, ab AS (SELECT set_id, attribute, count(*) AS samples, quantile_cont(value,0.5) AS obs,
  max(median) AS exp, sum(CASE WHEN value > median THEN 1 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN value < median THEN 1 ELSE 0 END)::DOUBLE AS b FROM tv GROUP BY 1, 2),
  x AS (SELECT *, unnest(range(0, least(a,b)::BIGINT+1))::DOUBLE AS i FROM ab),
  tested AS (SELECT set_id, attribute, any_value(samples) AS samples, any_value(obs) AS obs, any_value(exp) AS exp,
    least(1.0, 2*sum(exp(lgamma(a+b+1)-lgamma(i+1)-lgamma(a+b-i+1)-(a+b)*ln(2)))) AS pval FROM x GROUP BY 1, 2), {_fdr()}
  SELECT set_id, attribute AS name, samples::BIGINT AS samples, round(obs,6) AS obs, round(exp,6) AS exp, round(pval,8) AS pval, round(padj,8) AS padj,
  padj <= 0.05 AS significant FROM adj""")
def _(spark, d):
    res = en.numeric_enrichment(_numeric(spark, d), r.target_sets(spark, d), "gene")
    return rounded(rounded(res, ["obs", "exp"]), ["pval", "padj"], 8)


@query("numeric_enrichment_t_test", f"""{_BASE}, {_NUM}, {_MIDDLE}, ts AS (SELECT set_id, attribute, count(*)::BIGINT AS n, avg(value) AS obs, max(mean) AS mean,
  abs((avg(value)-max(mean))/(stddev_samp(value)/sqrt(count(*)))) AS t FROM tv GROUP BY 1, 2),
  grid AS (SELECT *, unnest(range(0, 20001)) AS i FROM ts),
  area AS (SELECT set_id, attribute, any_value(n) AS n, any_value(obs) AS obs, any_value(mean) AS mean, sum((CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
    * exp(lgamma(n/2.0::DOUBLE) - lgamma((n-1)/2.0::DOUBLE) - n/2.0::DOUBLE*ln(1 + (i*t/20000)^2/(n-1))) / sqrt((n-1)*pi())) * any_value(t)/20000/3 AS half FROM grid GROUP BY 1, 2)
  SELECT set_id, attribute AS name, n AS samples, round(obs,6)+0.0 AS obs, round(mean,6)+0.0 AS exp, round(1 - 2*half,6)+0.0 AS pval FROM area""")
def _(spark, d):
    return rounded(en.numeric_enrichment(_numeric(spark, d), r.target_sets(spark, d), "gene", parametric=True).select("set_id", "name", "samples", "obs", "exp", "pval"))


@query("numeric_t_statistics", f"""{_BASE}, {_NUM}, {_MIDDLE} SELECT set_id, attribute, round((avg(value)-max(mean))/(stddev_samp(value)/sqrt(count(*))),6)+0.0 AS t FROM tv GROUP BY 1, 2""")
def _(spark, d):
    values = _numeric(spark, d)
    centre = values.groupBy("attribute").agg(F.avg("value").alias("mean"))
    hit = values.join(r.target_sets(spark, d), "gene").groupBy("set_id", "attribute").agg(
        F.avg("value").alias("obs"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
    return rounded(hit.join(centre, "attribute").select(
        "set_id", "attribute", ((F.col("obs") - F.col("mean")) / (F.col("sd") / F.sqrt("n"))).alias("t")))


# --- multiple testing -----------------------------------------------------------------------------------------------------

_PV = "tested AS (SELECT gene, pvalue AS pval, p_type AS grp FROM de JOIN part ON p_partkey = gene)"


@query("fdr_benjamini_hochberg", f"WITH {r.DE}, {_PV}, {_fdr(group='1').replace('PARTITION BY 1', '')} SELECT gene, round(padj,8) AS padj FROM adj")
def _(spark, d):
    de = r.de_table(spark, d).select("gene", F.col("pvalue").alias("pval"))
    return rounded(ranking.fdr_adjust(de).select("gene", "padj"), digits=8)


@query("fdr_with_missing_per_group", f"""WITH {r.DE}, {_PV.replace('pvalue AS pval', 'CASE WHEN p_size > 5 THEN pvalue END AS pval')},
  full_t AS (SELECT * FROM tested), {_fdr('(SELECT * FROM tested WHERE pval IS NOT NULL)', 'grp')}
  SELECT full_t.gene, full_t.grp, round(padj,8) AS padj FROM full_t LEFT JOIN adj USING (gene)""")
def _(spark, d):
    part = r.table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("grp"), "p_size")
    de = r.de_table(spark, d).join(part, "gene").select("gene", "grp", F.when(F.col("p_size") > 5, F.col("pvalue")).alias("pval"))
    return rounded(ranking.fdr_adjust(de, groups=["grp"]).select("gene", "grp", "padj"), digits=8)


@query("fdr_benjamini_yekutieli", f"""WITH {r.DE}, {_PV}, {_fdr(group='1', extra='(SELECT sum(1.0::DOUBLE/j) FROM range(1, 1 + (SELECT count(*) FROM tested)) t(j))').replace('PARTITION BY 1', '')}
  SELECT gene, round(padj,8) AS padj FROM adj""")
def _(spark, d):
    de = r.de_table(spark, d).select("gene", F.col("pvalue").alias("pval"))
    return rounded(ranking.fdr_adjust(de, method="by").select("gene", "padj"), digits=8)


# --- ranked lists and randomisation -----------------------------------------------------------------------------------

def _ranked(spark, d):
    c = r.counts(spark, d).select("gene", sum(F.col(s) for s in r.SAMPLES).alias("total"))
    return ranking.row_numbers(c, [], [F.desc("total"), F.col("gene")], "rn").select("gene", (F.col("rn") - 1).alias("rank"))


@query("rank_vector", f"WITH {r.COUNTS} SELECT gene, row_number() OVER (ORDER BY {'+'.join(r.SAMPLES)} DESC, gene)::BIGINT - 1 AS rank FROM counts")
def _(spark, d):
    return _ranked(spark, d)


@query("ranked_list_enrichment", f"""{_BASE}, rkd AS (SELECT gene FROM counts WHERE gene IN (SELECT gene FROM attrs)), ks AS (SELECT attribute, count(*)::BIGINT AS k FROM attrs JOIN rkd USING (gene) GROUP BY 1)
  SELECT attribute AS name, (SELECT count(*) FROM rkd)::BIGINT AS samples, k AS successes, true AS bounded, true AS adjusted FROM ks""")
def _(spark, d):
    """The reported cutoff's tail bounds the p-value: tail <= p <= tail times the number of keys of the attribute, up to 1."""
    res = checkpoint(en.ranked_enrichment(r.attributes(spark, d), checkpoint(_ranked(spark, d)), "gene"))
    keys = r.attributes(spark, d).join(_ranked(spark, d), "gene").groupBy(F.col("attribute").alias("name")).agg(F.count(F.lit(1)).alias("successes"))
    found = F.col("obs") > 0
    draws = F.round(F.col("exp") * F.col("samples") / F.col("successes")).cast("long")
    tail = F.when(found, en._upper_tail("samples", draws, "successes", "obs")).otherwise(F.lit(1.0))
    rows = res.join(keys, "name").withColumn("tail", tail)
    slack = 1 + 1e-9
    return rows.select("name", "samples", "successes", ((F.col("tail") <= F.col("pval") * slack) & (
        F.col("pval") <= F.least(F.lit(1.0), F.col("tail") * F.col("successes")) * slack)).alias("bounded"), (F.col("padj") >= F.col("pval")).alias("adjusted"))


@query("ranked_list_statistic", f"""{_BASE}, rkd AS (SELECT gene, row_number() OVER (ORDER BY {'+'.join(r.SAMPLES)} DESC, gene) AS cut FROM counts),
  nn AS (SELECT count(*) AS population FROM rkd), ks AS (SELECT attribute, count(*) AS successes FROM attrs JOIN rkd USING (gene) GROUP BY 1),
  pos AS (SELECT attribute, cut AS draws, row_number() OVER (PARTITION BY attribute ORDER BY cut) AS hits FROM attrs JOIN rkd USING (gene)),
  cells AS (SELECT attribute AS set_id, attribute || ':' || draws AS attribute, population, draws, successes, hits FROM pos JOIN ks USING (attribute), nn
    WHERE draws <= floor(population*0.25) AND hits >= 10), {_pmf('cells')},
  tails AS (SELECT set_id, attribute, sum(CASE WHEN i >= hits THEN p ELSE 0 END) AS tail FROM pmf GROUP BY 1, 2)
  SELECT set_id AS attribute, round(min(tail),8) AS stat FROM tails GROUP BY 1""")
def _(spark, d):
    ranked = checkpoint(_ranked(spark, d))
    n = ranked.count()
    placed = r.attributes(spark, d).join(ranked, "gene")
    totals = placed.groupBy("attribute").agg(F.count(F.lit(1)).alias("successes"))
    pos = ranking.row_numbers(placed.filter(F.col("rank") < int(n * 0.25)).select("attribute", "rank"), ["attribute"], ["rank"], "hits")
    tails = pos.filter("hits >= 10").join(totals, "attribute").withColumn(
        "tail", en._upper_tail(F.lit(n), F.col("rank") + 1, "successes", "hits"))
    return rounded(tails.groupBy("attribute").agg(F.min("tail").alias("stat")), digits=8)


# Exact p-values of the statistic: all lattice paths, cutoff by cutoff, less those that touched a cell at least as extreme.
@query("ranked_list_pvalues", f"""{_BASE}, rkd AS (SELECT gene, row_number() OVER (ORDER BY {'+'.join(r.SAMPLES)} DESC, gene) AS cut FROM counts WHERE gene IN (SELECT gene FROM attrs)),
  nn AS (SELECT count(*) AS n, floor(count(*)*0.25)::BIGINT AS lowest FROM rkd), ks AS (SELECT attribute, count(*) AS k FROM attrs JOIN rkd USING (gene) GROUP BY 1),
  pos AS (SELECT attribute, e AS side, CASE WHEN e = 0 THEN cut ELSE n + 1 - cut END AS c FROM attrs JOIN rkd USING (gene), nn, (SELECT unnest([0, 1]) AS e)),
  cells AS (SELECT *, row_number() OVER (PARTITION BY attribute, side ORDER BY c) AS h FROM pos),
  sizes AS (SELECT DISTINCT k FROM ks), grid AS (SELECT k, c, n, unnest(range(0, least(k, c) + 1)) AS h FROM sizes, (SELECT unnest(range(1, lowest + 1)) AS c, n FROM nn)),
  pm AS (SELECT k, c, h, exp(lgamma(c+1)-lgamma(h+1)-lgamma(c-h+1)+lgamma(n-c+1)-lgamma(k-h+1)-lgamma(n-c-k+h+1)-lgamma(n+1)+lgamma(k+1)+lgamma(n-k+1)) AS p FROM grid WHERE n-c-k+h >= 0),
  tails AS MATERIALIZED (SELECT k, c, h, sum(p) OVER (PARTITION BY k, c ORDER BY h DESC) AS tail FROM pm),
  stats AS MATERIALIZED (SELECT ks.attribute, s.side, ks.k, coalesce(min(tail), 1.0) AS stat FROM ks JOIN (SELECT unnest([0, 1]) AS side) s ON true
    LEFT JOIN cells ON cells.attribute = ks.attribute AND cells.side = s.side AND cells.h >= 10 LEFT JOIN tails ON tails.k = ks.k AND tails.c = cells.c AND tails.h = cells.h GROUP BY 1, 2, 3),
  walk(attribute, side, k, c, h, p) AS (SELECT attribute, side, k, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE FROM stats WHERE stat < 1 UNION ALL
    (WITH nxt AS (SELECT attribute, side, k, c + 1 AS c, h, p * (1 - (k - h) / (n - c)::DOUBLE) AS p FROM walk, nn WHERE c < lowest UNION ALL
       SELECT attribute, side, k, c + 1, h + 1, p * ((k - h) / (n - c)::DOUBLE) FROM walk, nn WHERE c < lowest AND h < k)
     SELECT x.attribute, x.side, x.k, x.c, x.h, sum(x.p) FROM nxt x JOIN stats s ON s.attribute = x.attribute AND s.side = x.side LEFT JOIN tails t ON t.k = x.k AND t.c = x.c AND t.h = x.h
     WHERE x.p > 0 AND NOT (x.h >= 10 AND t.tail <= s.stat * (1 + 1e-9)) GROUP BY 1, 2, 3, 4, 5)),
  ps AS (SELECT attribute, side, greatest(0, 1 - sum(p)) AS p FROM walk, nn WHERE c = lowest GROUP BY 1, 2)
  SELECT stats.attribute AS name, round(min(coalesce(ps.p, 1.0)), 8) AS pval FROM stats LEFT JOIN ps USING (attribute, side) GROUP BY 1""")
def _(spark, d):
    return rounded(en.ranked_enrichment(r.attributes(spark, d), checkpoint(_ranked(spark, d)), "gene").select("name", "pval"), digits=8)


# The tail of the mean of a random subset by its first three moments (a finite population, drawn without replacement).
@query("fold_change_randomization", f"""WITH {r.FC}, t AS (SELECT count(*)::BIGINT AS n, avg(fc) AS m FROM fcs WHERE gene IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO'))
  SELECT n AS group_size, round(m,6) AS observed_fold_change, round((SELECT avg(fc) FROM fcs),6) AS expected_fold_change, true AS near FROM t""")
def _(spark, d):
    """The drawn p-value is within four of its own standard errors, and the third-order error of the expansion, of that tail."""
    fc = checkpoint(r.fold_changes(spark, d))
    picked = fc.join(r.table(spark, d, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("gene")), "gene", "left_semi")
    row = en.fold_change_randomization(picked, fc, "gene", "fc", seed=11, bucket_rows=500)
    spread_, skew, total = fc.agg(F.stddev_samp("fc"), F.skewness("fc"), F.count("fc")).first()
    size = picked.count()
    error = spread_ * math.sqrt((1 - size / total) / size)
    skewed = skew * (total - 2 * size) / math.sqrt(size * total * max(total - size, 1))
    got = row.first()
    side = 1 if got["observed_fold_change"] > got["expected_fold_change"] else -1
    z, g = side * (got["observed_fold_change"] - got["expected_fold_change"]) / error, side * skewed
    tail = 0.5 * math.erfc(z / math.sqrt(2)) + g * (z * z - 1) * math.exp(-z * z / 2) / (6 * math.sqrt(2 * math.pi))
    allowed = 4 * math.sqrt(max(tail, 1e-4) / 10_000) + 1 / size
    return rounded(row.withColumn("near", F.abs(F.col("pval") - F.lit(tail)) <= F.lit(allowed)).select("group_size", "observed_fold_change", "expected_fold_change", "near"))


# --- ontology: brand, type and size classes of parts with a shared root -------------------------------------------------

_LEAF = "p_brand || '|' || p_type"
_FINE = _LEAF + " || '|size_' || CAST(CAST(floor(p_size/10) AS BIGINT) AS VARCHAR)"
_SIZE = "'size_' || CAST(CAST(floor(p_size/10) AS BIGINT) AS VARCHAR)"
_EDGES = f"""edges AS (SELECT DISTINCT {_FINE} AS child, {_LEAF} AS parent, 'is_a' AS rel FROM part UNION SELECT {_FINE}, {_SIZE}, 'part_of' FROM part
  UNION SELECT {_LEAF}, p_brand, 'is_a' FROM part UNION SELECT {_LEAF}, p_type, 'part_of' FROM part UNION SELECT {_FINE}, p_type, 'regulates' FROM part
  UNION SELECT p_brand, 'part', 'is_a' FROM part UNION SELECT p_type, 'part', 'is_a' FROM part UNION SELECT {_SIZE}, 'part', 'is_a' FROM part),
  pe AS (SELECT DISTINCT child, parent FROM edges WHERE rel IN ('is_a','part_of')),
  nodes AS (SELECT DISTINCT child AS term FROM edges UNION SELECT 'part'),
  closure AS (SELECT child AS term, parent AS ancestor FROM pe UNION SELECT closure.term, pe.parent FROM closure JOIN pe ON pe.child = closure.ancestor),
  dir AS (SELECT {_FINE} AS term, p_partkey AS gene FROM part),
  prop AS (SELECT * FROM dir UNION SELECT ancestor, gene FROM dir JOIN closure USING (term))"""
_ONTO = f"WITH RECURSIVE {r.COUNTS}, {r.TARGETS}, {_EDGES}"
_LVL = """lv AS (SELECT term, 0 AS level FROM nodes WHERE term NOT IN (SELECT child FROM pe) UNION SELECT pe.child, lv.level+1 FROM lv JOIN pe ON pe.parent = lv.term)"""


def ontology(spark, d):
    part = r.table(spark, d, "part")
    band = F.concat(F.lit("size_"), F.floor(F.col("p_size") / 10).cast("string"))
    leaf = F.concat_ws("|", "p_brand", "p_type")
    fine = F.concat_ws("|", leaf, band)
    root = F.lit("part")

    def edge(child, parent, rel):
        return F.struct(child.alias("child"), parent.alias("parent"), F.lit(rel).alias("rel"))

    brand, kind = F.col("p_brand"), F.col("p_type")
    edges = part.select(F.inline(F.array(
        edge(fine, leaf, "is_a"), edge(fine, band, "part_of"), edge(leaf, brand, "is_a"), edge(leaf, kind, "part_of"),
        edge(fine, kind, "regulates"), edge(brand, root, "is_a"), edge(kind, root, "is_a"), edge(band, root, "is_a")))).distinct()
    edges = checkpoint(edges)
    nodes = edges.select(F.inline(F.array(F.struct(F.col("child").alias("term")), F.struct(F.col("parent").alias("term"))))).distinct()
    direct = part.select(fine.alias("term"), F.col("p_partkey").alias("gene"))
    return nodes, edges, direct


@query("ontology_levels", f"{_ONTO}, {_LVL} SELECT term, max(level)::INTEGER AS level FROM lv GROUP BY 1")
def _(spark, d):
    nodes, edges, _ = ontology(spark, d)
    return onto.levels(nodes, onto.parent_edges(edges))


@query("ontology_children", f"{_ONTO} SELECT parent, child FROM pe")
def _(spark, d):
    return onto.children(onto.parent_edges(ontology(spark, d)[1]))


@query("ontology_ancestor_closure", f"{_ONTO} SELECT term, ancestor FROM closure")
def _(spark, d):
    return onto.ancestors(onto.parent_edges(ontology(spark, d)[1]))


@query("ontology_propagation", f"{_ONTO} SELECT term, gene FROM prop")
def _(spark, d):
    _, edges, direct = ontology(spark, d)
    return onto.propagate(direct, onto.ancestors(onto.parent_edges(edges)), "gene")


@query("ontology_level_order", f"{_ONTO}, {_LVL}, l AS (SELECT term, max(level)::INTEGER AS level FROM lv GROUP BY 1) SELECT term, level FROM l ORDER BY level DESC, term")
def _(spark, d):
    nodes, edges, _ = ontology(spark, d)
    return onto.level_order(onto.levels(nodes, onto.parent_edges(edges)))


@query("ontology_alternative_ids", f"""{_ONTO}, alt AS (SELECT DISTINCT lower(p_type) AS alt_id, p_type AS term FROM part), use AS (
  SELECT p_partkey AS gene, CASE WHEN p_size > 20 THEN lower(p_type) ELSE p_name END AS term FROM part)
  SELECT gene, coalesce(alt.term, use.term) AS term FROM use LEFT JOIN alt ON alt.alt_id = use.term WHERE coalesce(alt.term, use.term) IN (SELECT term FROM nodes)""")
def _(spark, d):
    nodes, _, _ = ontology(spark, d)
    part = r.table(spark, d, "part")
    alt = part.select(F.lower("p_type").alias("alt_id"), F.col("p_type").alias("term")).distinct()
    use = part.select(F.col("p_partkey").alias("gene"), F.when(F.col("p_size") > 20, F.lower("p_type")).otherwise(F.col("p_name")).alias("term"))
    return onto.resolve_alternatives(use, "term", alt, nodes)


@query("filter_by_terms", f"{_ONTO} SELECT gene, a_f FROM counts WHERE gene IN (SELECT gene FROM prop WHERE term IN ('Brand#4','size_1') GROUP BY gene HAVING count(DISTINCT term) = 2)")
def _(spark, d):
    _, edges, direct = ontology(spark, d)
    closure = onto.ancestors(onto.parent_edges(edges))
    return attr.filter_by_terms(r.counts(spark, d).select("gene", "a_f"), "gene", direct, ["Brand#4", "size_1"], closure, "intersection")


@query("filter_by_pathway", f"""WITH {r.COUNTS} SELECT gene, a_f FROM counts WHERE gene IN (SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  WHERE s_nationkey = 3)""")
def _(spark, d):
    li, s = r.table(spark, d, "lineitem"), r.table(spark, d, "supplier")
    members = li.join(s, li["l_suppkey"] == s["s_suppkey"]).select(
        F.col("s_nationkey").cast("string").alias("pathway"), F.col("l_partkey").alias("gene"))
    return attr.filter_by_pathway(r.counts(spark, d).select("gene", "a_f"), "gene", members, "3")


def _term_inputs(spark, d):
    nodes, edges, direct = ontology(spark, d)
    up = stored(onto.parent_edges(edges))
    return direct, r.target_sets(spark, d), "gene", stored(onto.levels(nodes, up)).withColumn("namespace", F.lit("parts")), up


def _term_tests(inputs, **options):
    return _round(en.ontology_enrichment(*inputs, **options).drop("namespace"))


_TERM_OUT = f"{_OUT}, level FROM adj JOIN (SELECT term, max(level)::INTEGER AS level FROM lv GROUP BY 1) l ON l.term = adj.attribute"


@query("ontology_enrichment_classic", f"{_ONTO}, {_LVL}, ann AS (SELECT term AS attribute, gene FROM prop), {_PARAMS}, {_FISHER}, {_fdr(extra=_BY)} {_TERM_OUT}")
def _(spark, d):
    return _term_tests(_term_inputs(spark, d), propagate="classic")


@query("ontology_enrichment_unpropagated", f"{_ONTO}, {_LVL}, ann AS (SELECT term AS attribute, gene FROM dir), {_PARAMS}, {_HYPER}, {_fdr(extra=_BY)} {_TERM_OUT}")
def _(spark, d):
    return _term_tests(_term_inputs(spark, d), propagate="no", test="hypergeometric")


def _elim_sql(alpha: float, depth: int) -> str:
    """Level by level: the p-values of a level use what its significant descendants left over."""
    parts, seen = [], []
    score = "hits > 0 AND (hits/draws::DOUBLE) > (successes/population::DOUBLE)"
    for level in range(depth, -1, -1):
        lost = "SELECT NULL::VARCHAR AS set_id, NULL::VARCHAR AS attribute, 0 AS lost, 0 AS lost_hits WHERE false"
        if seen:
            lost = f"""SELECT x.set_id, x.attribute, count(*) AS lost, count(tg.gene) AS lost_hits FROM (SELECT DISTINCT sg.set_id, closure.ancestor AS attribute, ann.gene
              FROM ({" UNION ALL ".join(f"SELECT * FROM sg{v}" for v in seen)}) sg JOIN closure ON closure.term = sg.attribute JOIN ann ON ann.attribute = sg.attribute) x
              LEFT JOIN tg ON tg.set_id = x.set_id AND tg.gene = x.gene GROUP BY 1, 2"""
        parts.append(f"""lo{level} AS ({lost}), ba{level} AS (SELECT prm.set_id, prm.attribute, population, draws, successes AS full_s, hits AS full_h,
          successes - coalesce(lost,0) AS successes, hits - coalesce(lost_hits,0) AS hits FROM prm JOIN mx ON mx.term = prm.attribute AND mx.level = {level}
          LEFT JOIN lo{level} l ON l.set_id = prm.set_id AND l.attribute = prm.attribute), {_pmf(f"ba{level}", level)},
          ob{level} AS (SELECT set_id, attribute, p AS po FROM pmf{level} WHERE i = hits), te{level} AS (SELECT b.set_id, b.attribute, any_value(population) AS population,
          any_value(draws) AS draws, any_value(full_s) AS successes, any_value(full_h) AS hits, least(1.0, sum(CASE WHEN p <= po*(1+1e-7) THEN p ELSE 0 END)) AS pval
          FROM pmf{level} b JOIN ob{level} o ON o.set_id = b.set_id AND o.attribute = b.attribute GROUP BY 1, 2),
          sg{level} AS (SELECT set_id, attribute FROM te{level} WHERE pval <= {alpha} AND {score})""")
        seen.append(level)
    union = " UNION ALL ".join(f"SELECT * FROM te{v}" for v in seen)
    return ", ".join(parts) + f", tested AS ({union})"


@query("ontology_enrichment_elim", f"""{_ONTO}, {_LVL}, mx AS (SELECT term, max(level)::INTEGER AS level FROM lv GROUP BY 1), ann AS (SELECT term AS attribute, gene FROM prop),
  {_PARAMS}, {_elim_sql(0.2, 3)}, {_fdr(extra=_BY)} {_TERM_OUT.replace("0.05", "0.2")}""")
def _(spark, d):
    return _term_tests(_term_inputs(spark, d), propagate="elim", alpha=0.2)


@query("ranked_ontology_elim", f"""{_ONTO}, own AS (SELECT DISTINCT term, gene FROM prop WHERE gene IN (SELECT gene FROM counts))
  SELECT term AS name, (SELECT count(DISTINCT gene) FROM own)::BIGINT AS samples, count(*)::BIGINT AS keys, true AS sound FROM own GROUP BY term""")
def _(spark, d):
    """Terms without a significant descendant keep the p-value they have without elimination, and others have no more hits than they had keys."""
    nodes, edges, direct = ontology(spark, d)
    up = checkpoint(onto.parent_edges(edges))
    leveled, ranked, direct = checkpoint(onto.levels(nodes, up)), checkpoint(_ranked(spark, d)), checkpoint(direct)
    elim = checkpoint(en.ranked_ontology_enrichment(direct, ranked, "gene", leveled, up, alpha=0.2))
    classic = en.ranked_ontology_enrichment(direct, ranked, "gene", leveled, up, propagate="classic").select("name", F.col("pval").alias("before"))
    closure = checkpoint(onto.ancestors(up))
    strong = elim.filter("pval <= 0.2 AND log2_enrichment_score > 0").select(F.col("name").alias("term"))
    touched = closure.join(strong, "term").select(F.col("ancestor").alias("name")).distinct().withColumn("touched", F.lit(True))
    keys = onto.propagate(direct, closure, "gene").join(ranked, "gene", "left_semi").groupBy(F.col("term").alias("name")).agg(F.countDistinct("gene").alias("keys"))
    same = F.abs(F.col("pval") - F.col("before")) <= 1e-9 * F.col("before")
    return elim.join(classic, "name", "left").join(touched, "name", "left").join(keys, "name").select(
        "name", "samples", "keys", ((F.col("obs") <= F.col("keys")) & F.when(F.col("touched"), F.col("pval").between(0, 1)).otherwise(same)).alias("sound"))


_TERMS = f"""{_ONTO}, ann AS (SELECT term AS attribute, gene FROM prop), {_PARAMS} SELECT set_id, attribute AS name, draws::BIGINT AS samples, hits::BIGINT AS obs,
  round(draws*successes/population::DOUBLE, 6) AS exp, true AS sound FROM prm"""


@query("ontology_enrichment_weight", _TERMS)
def _(spark, d):
    """Weighting keeps counts and expectations, p-values are probabilities and adjusted ones no smaller."""
    res = _term_tests(_term_inputs(spark, d), propagate="weight")
    return res.select("set_id", "name", "samples", "obs", "exp", (F.col("pval").between(0, 1) & (F.col("padj") >= F.col("pval"))).alias("sound"))


@query("ontology_enrichment_combined", _TERMS)
def _(spark, d):
    """The combined p-value is the geometric mean of the three methods'."""
    direct, targets, *rest = _term_inputs(spark, d)
    inputs = direct, checkpoint(targets), *rest
    each = {m: checkpoint(_term_tests(inputs, propagate=m).select("set_id", "name", "samples", "obs", "exp", F.col("pval").alias(m))) for m in ("classic", "elim", "weight", "all.m")}
    rows = each["all.m"]
    for m in ("classic", "elim", "weight"):
        rows = rows.join(each[m].select("set_id", "name", m), ["set_id", "name"])
    mean = F.pow(F.col("classic") * F.col("elim") * F.col("weight"), 1 / 3)
    return rows.select("set_id", "name", "samples", "obs", "exp", (F.abs(F.col("`all.m`") - mean) <= 1e-3).alias("sound"))


@query("enrichment_top_results", f"{_BASE}, ann AS (SELECT * FROM attrs), {_PARAMS}, {_FISHER}, {_fdr()} SELECT * FROM ({_OUT} FROM adj ORDER BY adj.padj, adj.pval, set_id, name LIMIT 10)")
def _(spark, d):
    return _round(en.top_results(en.enrichment(r.attributes(spark, d), r.target_sets(spark, d), "gene"), 10))


@query("ontology_significant_subgraph", f"""{_ONTO}, hits AS (SELECT DISTINCT {_FINE} AS term FROM part WHERE p_size >= 40 AND p_type = 'PROMO'),
  nd AS (SELECT term FROM hits UNION SELECT ancestor FROM closure WHERE term IN (SELECT term FROM hits))
  SELECT child, parent FROM pe WHERE child IN (SELECT term FROM nd) AND parent IN (SELECT term FROM nd)""")
def _(spark, d):
    _, edges, _ = ontology(spark, d)
    part = r.table(spark, d, "part").filter("p_size >= 40 and p_type = 'PROMO'")
    term = F.concat_ws("|", "p_brand", "p_type", F.concat(F.lit("size_"), F.floor(F.col("p_size") / 10).cast("string")))
    results = part.select(term.alias("term"), F.lit(True).alias("significant"))
    up = onto.parent_edges(edges)
    return onto.significant_subgraph(results, up, onto.ancestors(up))[1]


@query("pathway_node_degrees", """WITH e AS (SELECT DISTINCT s_nationkey::BIGINT AS source, c_nationkey::BIGINT AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey), n AS (SELECT source AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e)
  SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*)::BIGINT AS degree FROM n GROUP BY 1""")
def _(spark, d):
    return onto.node_degrees(_trade(spark, d))


def _trade(spark, d):
    li, o, c, s = (r.table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    return (li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
            .join(s, li["l_suppkey"] == s["s_suppkey"]).select(
                F.col("s_nationkey").cast("long").alias("source"), F.col("c_nationkey").cast("long").alias("target")).distinct())


@query("pathway_marked_nodes", f"""WITH {r.COUNTS}, {r.TARGET} SELECT n_nationkey::BIGINT AS entry, n_name AS name, n_nationkey IN (SELECT s_nationkey FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey IN (SELECT gene FROM target)) AS marked FROM nation""")
def _(spark, d):
    li, s = r.table(spark, d, "lineitem"), r.table(spark, d, "supplier")
    nodes = r.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("entry"), F.col("n_name").alias("name"))
    members = li.join(s, li["l_suppkey"] == s["s_suppkey"]).select(
        F.col("s_nationkey").cast("long").alias("entry"), F.col("l_partkey").alias("gene"))
    return onto.marked_pathway(nodes, members, r.target_set(spark, d), "gene")
