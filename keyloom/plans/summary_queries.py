"""Aggregates, column functions and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregates as agg
from ..operators import filters, normalize, sorting
from ..operators.ranking import quantiles
from . import relations as r
from .registry import query, rounded

_C = f"WITH {r.COUNTS} "
_D = f"WITH {r.DE} "
S = r.SAMPLES


def _unpivot(columns=S, source="counts", key="gene, "):
    return " UNION ALL ".join(f"SELECT {key}'{c}' AS sample, {c}::DOUBLE AS value FROM {source}" for c in columns)


def _each(fmt, columns=S):
    return ", ".join(fmt.format(c=c) for c in columns)


# --- aggregates ----------------------------------------------------------------------------------------------------

_NEAREST = "max(CASE WHEN i = floor((n-1)*{p}+0.5) THEN x END) AS \"{name}\""


@query("describe", f"""{_D}, u AS (SELECT 'log2FoldChange' AS col, "log2FoldChange" AS x FROM de
  UNION ALL SELECT 'padj', padj FROM de UNION ALL SELECT 'baseMean', "baseMean" FROM de),
  o AS (SELECT col, x, row_number() OVER (PARTITION BY col ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY col) AS n
    FROM u WHERE x IS NOT NULL),
  q AS (SELECT col, {", ".join(_NEAREST.format(p=p, name=f"{p*100:g}%") for p in (.01, .25, .5, .75, .99))} FROM o GROUP BY col)
  SELECT u.col AS "column", count(x)::BIGINT AS "count", sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END)::BIGINT AS null_count,
  round(avg(x),6) AS mean, round(stddev_samp(x),6) AS std, round(min(x),6) AS "min", round(max(x),6) AS "max",
  {", ".join(f'round(any_value("{p*100:g}%"),6) AS "{p*100:g}%"' for p in (.01, .25, .5, .75, .99))}
  FROM u JOIN q USING (col) GROUP BY u.col""")
def _(spark, d):
    return rounded(agg.describe(r.de_table(spark, d).select("log2FoldChange", "padj", "baseMean")))


@query("biotypes_from_ref_table", f"""{_C} SELECT coalesce(p_type, '{agg.MISSING_BIOTYPE}') AS biotype, count(*)::BIGINT AS "count"
  FROM (SELECT DISTINCT gene FROM counts) LEFT JOIN (SELECT * FROM part WHERE p_size > 3) ON p_partkey = gene GROUP BY 1""")
def _(spark, d):
    ref = r.table(spark, d, "part").filter("p_size > 3")
    return agg.biotypes(r.counts(spark, d), "gene", ref, "p_partkey", "p_type")


def _long_stats(c):
    return (f'count({c})::BIGINT AS {c}_count, round(avg({c}),6) AS {c}_mean, round(stddev_samp({c}),6) AS {c}_std, '
            f'min({c}) AS {c}_min, ' + ", ".join(
                f'round(quantile_cont({c}, {q/100}),6) AS "{c}_{q}%"' for q in (25, 50, 75)) + f', max({c}) AS {c}_max')


@query("biotypes_long_format", f"""{_C} SELECT coalesce(p_type, '{agg.MISSING_BIOTYPE}') AS biotype,
  {", ".join(_long_stats(c) for c in S)} FROM counts LEFT JOIN (SELECT * FROM part WHERE p_size > 3) ON p_partkey = gene
  GROUP BY 1""")
def _(spark, d):
    ref = r.table(spark, d, "part").filter("p_size > 3")
    return rounded(agg.biotypes_long(r.counts(spark, d), "gene", ref, "p_partkey", "p_type"))


_GROUPS = [["a_f", "a_o"], ["n_f", "n_o", "r_f"], ["r_o"]]


@query("average_replicates_mean", f"""{_C} SELECT gene, round((a_f+a_o)/2,6) AS "a_f;a_o", round((n_f+n_o+r_f)/3,6) AS "n_f;n_o;r_f",
  r_o FROM counts""")
def _(spark, d):
    return rounded(agg.average_replicates(r.counts(spark, d), "gene", _GROUPS))


@query("average_replicates_median", f"""{_C} SELECT gene, round((a_f+a_o)/2,6) AS a,
  list_sort([n_f,n_o,r_f])[2] AS b FROM counts""")
def _(spark, d):
    return rounded(agg.average_replicates(r.counts(spark, d), "gene", _GROUPS[:2], ["a", "b"], "median"))


@query("average_replicates_geometric_mean", f"""{_C} SELECT gene, round(CASE WHEN least(a_f,a_o) <= 0 THEN 0 ELSE exp((ln(a_f)+ln(a_o))/2) END,6) AS a,
  round(CASE WHEN least(n_f,n_o,r_f) <= 0 THEN 0 ELSE exp((ln(n_f)+ln(n_o)+ln(r_f))/3) END,6) AS b
  FROM counts""")
def _(spark, d):
    return rounded(agg.average_replicates(r.counts(spark, d), "gene", _GROUPS[:2], ["a", "b"], "geometric_mean"))


@query("fold_change", f"WITH {r.FC} SELECT gene, round(fc,6) AS fc FROM fcs")
def _(spark, d):
    return rounded(r.fold_changes(spark, d))


@query("quantile_interpolations", f"""{_C}, u AS ({_unpivot()}), o AS (SELECT sample, value,
  row_number() OVER (PARTITION BY sample ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY sample) - 1 AS h FROM u),
  p AS (SELECT sample, max(CASE WHEN i = floor(h*0.37) THEN value END) AS lo, max(CASE WHEN i = ceil(h*0.37) THEN value END) AS hi,
  max(CASE WHEN i = floor(h*0.37+0.5) THEN value END) AS nearest, max(h)*0.37::DOUBLE - floor(max(h)*0.37::DOUBLE) AS f FROM o GROUP BY sample)
  SELECT sample, lo AS lower, hi AS higher, nearest, (lo+hi)/2 AS midpoint, round(lo+(hi-lo)*f,6) AS linear FROM p""")
def _(spark, d):
    long = agg.to_long(r.counts(spark, d), "gene", S)
    out = None
    for kind in ("lower", "higher", "nearest", "midpoint", "linear"):
        q = quantiles(long, "value", {kind: 0.37}, ["sample"], kind)
        out = q if out is None else out.join(q, "sample")
    return rounded(out)


@query("histogram", """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
  h AS (SELECT least(floor((l_extendedprice-lo)/((hi-lo)/100)), 99)::INTEGER AS bin, count(*)::BIGINT AS n FROM lineitem, e GROUP BY 1)
  SELECT g.bin::INTEGER AS bin, round(lo + g.bin*((hi-lo)/100),6) AS lower, round(lo + (g.bin+1)*((hi-lo)/100),6) AS upper,
  coalesce(n,0)::BIGINT AS "count" FROM range(100) g(bin) CROSS JOIN e LEFT JOIN h ON h.bin = g.bin""")
def _(spark, d):
    return rounded(agg.histogram(r.table(spark, d, "lineitem"), "l_extendedprice", 100))


@query("pvalue_histogram", f"""{_D}, h AS (SELECT least(floor((pvalue-0.0)/(1.0::DOUBLE/20)),19)::INTEGER AS bin, count(*) AS n FROM de GROUP BY 1)
  SELECT g.bin::INTEGER AS bin, round(g.bin*(1.0::DOUBLE/20),6) AS lower, round((g.bin+1)*(1.0::DOUBLE/20),6) AS upper,
  coalesce(n,0)::BIGINT AS "count" FROM range(20) g(bin) LEFT JOIN h ON h.bin = g.bin""")
def _(spark, d):
    return rounded(agg.pvalue_histogram(r.de_table(spark, d)))


@query("observed_expected_histogram", f"""WITH {r.COUNTS}, {r.TARGET}, u AS (SELECT 'p_size' AS attribute, p_partkey AS gene, p_size::DOUBLE AS x FROM part
  UNION ALL SELECT 'p_retailprice', p_partkey, p_retailprice FROM part),
  e AS (SELECT attribute, min(x) AS lo, max(x) AS hi FROM u GROUP BY 1)
  SELECT attribute, least(floor((x-lo)/((hi-lo)/25)),24)::INTEGER AS bin, count(*)::BIGINT AS expected,
  count(target.gene)::BIGINT AS observed FROM u JOIN e USING (attribute) LEFT JOIN target ON target.gene = u.gene GROUP BY 1, 2""")
def _(spark, d):
    part = r.table(spark, d, "part").withColumnRenamed("p_partkey", "gene")
    long = agg.to_long(part, "gene", ["p_size", "p_retailprice"], "attribute")
    return agg.observed_expected_histogram(long, r.target_set(spark, d), "gene", 25)


@query("expression_centre_spread", f"""{_C}, g AS (SELECT gene, 'f' AS "group", a_f AS x, n_f AS y, r_f AS z FROM counts
  UNION ALL SELECT gene, 'o', a_o, n_o, r_o FROM counts), m AS (SELECT *, (x+y+z)/3 AS centre FROM g)
  SELECT gene, "group", round(centre,6) AS centre, round(sqrt(((x-centre)^2+(y-centre)^2+(z-centre)^2)/2)/sqrt(3.0::DOUBLE),6) AS below,
  round(sqrt(((x-centre)^2+(y-centre)^2+(z-centre)^2)/2)/sqrt(3.0::DOUBLE),6) AS above FROM m""")
def _(spark, d):
    groups = {"f": r.F_SAMPLES, "o": r.O_SAMPLES}
    return rounded(agg.group_centre_spread(r.counts(spark, d), "gene", groups))


@query("expression_median_range", f"""{_C}, g AS (SELECT gene, 'f' AS "group", list_sort([a_f, n_f, r_f]) AS v FROM counts
  UNION ALL SELECT gene, 'o', list_sort([a_o, n_o, r_o]) FROM counts)
  SELECT gene, "group", v[2] AS centre, v[2]-v[1] AS below, v[3]-v[2] AS above FROM g""")
def _(spark, d):
    groups = {"f": r.F_SAMPLES, "o": r.O_SAMPLES}
    return rounded(agg.group_centre_spread(r.counts(spark, d), "gene", groups, "median", "range"))


@query("distribution_summary", f"""{_C}, u AS ({_unpivot()}), y AS (SELECT sample, log10(value+1) AS y FROM u)
  SELECT sample, count(*)::BIGINT AS "count", round(min(y),6) AS "min", round(quantile_cont(y,.25),6) AS q1,
  round(quantile_cont(y,.5),6) AS median, round(quantile_cont(y,.75),6) AS q3, round(max(y),6) AS "max" FROM y GROUP BY sample""")
def _(spark, d):
    return rounded(agg.distribution_summary(r.counts(spark, d), S))


@query("letter_values", f"""{_C}, u AS ({_unpivot()}), y AS (SELECT sample, log10(value+1) AS y FROM u)
  SELECT sample, round(quantile_cont(y,.5),6) AS median, {", ".join(
      f"round(quantile_cont(y,{1/2**k}),6) AS lower_{2**k}, round(quantile_cont(y,{1-1/2**k}),6) AS upper_{2**k}" for k in range(2, 7))}
  FROM y GROUP BY sample""")
def _(spark, d):
    return rounded(agg.letter_values(r.counts(spark, d), S))


@query("sample_points", f"""WITH {r.COUNTS}, {r.TARGET} SELECT gene, round(log10((a_f+n_f)/2+1),6) AS x, round(log10(r_o+1),6) AS y,
  gene IN (SELECT gene FROM target) AS highlight FROM counts""")
def _(spark, d):
    return rounded(agg.sample_points(r.counts(spark, d), "gene", ["a_f", "n_f"], ["r_o"], r.target_set(spark, d)))


_PAIRS = [(a, b) for i, a in enumerate(S) for b in S[i + 1:]]


@query("spearman_pairs", f"""{_C}, k AS (SELECT gene, {_each('rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0::DOUBLE AS {c}')} FROM counts)
  {" UNION ALL ".join(f"SELECT '{a}' AS sample_a, '{b}' AS sample_b, round(corr({a},{b}),6) AS rho FROM k" for a, b in _PAIRS)}""")
def _(spark, d):
    return rounded(agg.spearman(r.counts(spark, d), "gene", S))


@query("library_sizes", f"{_C} SELECT {_each('sum({c}) AS {c}')} FROM counts")
def _(spark, d):
    return r.counts(spark, d).agg(*[F.sum(c).alias(c) for c in S])


# --- column functions ----------------------------------------------------------------------------------------------

@query("transform_logs", f"{_C} SELECT gene, round(log2(a_f+1),6) AS a_f, round(log10(a_o+1),6) AS a_o, round(ln(n_f+1),6) AS n_f, round(ln(n_o+1)/ln(3),6) AS n_o FROM counts")
def _(spark, d):
    c = r.counts(spark, d).select("gene", "a_f", "a_o", "n_f", "n_o")
    for column, name in (("a_f", "log2"), ("a_o", "log10"), ("n_f", "ln"), ("n_o", "log3")):
        c = scalar.transform_columns(c, [column], name)
    return rounded(c)


@query("transform_column_function", f"{_C} SELECT gene, round(sqrt(a_f)*2+1,6) AS a_f, round(sqrt(r_o)*2+1,6) AS r_o FROM counts")
def _(spark, d):
    c = r.counts(spark, d).select("gene", "a_f", "r_o")
    return rounded(scalar.transform_columns(c, ["a_f", "r_o"], lambda x: F.sqrt(x) * 2 + 1))


@query("standardize", f"""{_C} SELECT gene, {_each('round(({c}-avg({c}) OVER ())/stddev_pop({c}) OVER (),6)+0.0 AS {c}')} FROM counts""")
def _(spark, d):
    return rounded(scalar.standardize(r.matrix(spark, d), S))


@query("box_cox", f"{_C}, u AS ({_unpivot()}) SELECT sample, count(*)::BIGINT AS n, true AS near_grid, true AS standardised FROM u GROUP BY 1")
def _(spark, d):
    """The fitted power beats those a hundredth to either side in likelihood, and the transformed column is standardised."""
    m = r.matrix(spark, d)
    powers = scalar.box_cox_lambdas(m, S)
    long = agg.to_long(m, "gene", S).withColumn("c", F.ln(F.col("value") + 1))
    centred = long.join(long.groupBy("sample").agg(F.avg("c").alias("m")), "sample").withColumn("c", F.col("c") - F.col("m"))
    lam = F.element_at(F.create_map(*[F.lit(x) for s in S for x in (s, powers[s])]), F.col("sample"))

    def score(step):
        p = lam + step
        return -F.ln(F.var_pop(F.when(F.abs(p) < 1e-12, F.col("c")).otherwise((F.exp(p * F.col("c")) - 1) / p)))
    peak = centred.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), ((score(0.0) >= score(-0.01)) & (score(0.0) >= score(0.01))).alias("near_grid"))
    shaped = agg.to_long(scalar.box_cox(m, S), "gene", S).groupBy("sample").agg(
        ((F.abs(F.avg("value")) < 1e-9) & (F.abs(F.stddev_pop("value") - 1) < 1e-9)).alias("standardised"))
    return peak.join(shaped, "sample").select("sample", "n", "near_grid", "standardised")


@query("shift_to_baseline", f"{_C}, m AS (SELECT min(least({_each('{c}')})) AS lo FROM counts) SELECT gene, {_each('{c}-lo+1 AS {c}')} FROM counts, m")
def _(spark, d):
    return scalar.shift_to_baseline(r.matrix(spark, d), S, 1)


@query("extract_ids_from_text", """SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+')) AS id FROM documents""")
def _(spark, d):
    return scalar.extract_ids(r.table(spark, d, "documents"), "text", "[a-z0-9.]+@[a-z0-9.]+")


@query("transform_element_function", f"{_C} SELECT gene, round(a_f*2+3,6) AS a_f, r_o FROM counts")
def _(spark, d):
    c = r.counts(spark, d).select("gene", "a_f", "r_o")
    return rounded(scalar.map_elements(c, ["a_f"], lambda x, shift: x * 2 + shift, shift=3))


@query("extract_sequence_names_from_pages", """SELECT DISTINCT unnest(regexp_extract_all(html, '[A-Z,0-9]{2,8}\\.[0-9]{1,2}')) AS id FROM pages""")
def _(spark, d):
    return scalar.extract_ids(r.table(spark, d, "pages"), "html", r"[A-Z,0-9]{2,8}\.[0-9]{1,2}")


@query("first_accession_in_text", """SELECT doc_id, nullif(regexp_extract(text, '([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})', 1), '') AS accession,
  nullif(regexp_extract(text, '(GO:[0-9]{7})', 1), '') AS term FROM documents""")
def _(spark, d):
    return r.table(spark, d, "documents").select(
        "doc_id", scalar.first_id("text", scalar.UNIPROT_PATTERN).alias("accession"),
        scalar.first_id("text", scalar.GO_PATTERN).alias("term"))


@query("name_cleanup", r"""SELECT page_id, CASE WHEN regexp_matches(c, '^[0-9]') THEN 'var_' || c ELSE c END AS variable, stem FROM
  (SELECT page_id, regexp_replace(rtrim(url), '[^\p{L}\p{N}]', '_', 'g') AS c, regexp_replace(url, '([^/])\.[^/]*$', '\1') AS stem FROM pages)""")
def _(spark, d):
    return r.table(spark, d, "pages").select("page_id", scalar.sanitize_name("url").alias("variable"),
                                             scalar.strip_suffixes("url").alias("stem"))


@query("pvalue_stars", f"""{_D} SELECT gene, CASE WHEN pvalue > 0.05 THEN 'ns' WHEN pvalue < 0.0001 THEN '****' WHEN pvalue < 0.001 THEN '***'
  WHEN pvalue < 0.01 THEN '**' ELSE '*' END AS stars FROM de""")
def _(spark, d):
    return r.de_table(spark, d).select("gene", scalar.pvalue_stars("pvalue").alias("stars"))


@query("pair_counts", "SELECT p_brand, count(*)*(count(*)-1)/2.0::DOUBLE AS pairs FROM part GROUP BY p_brand")
def _(spark, d):
    n = r.table(spark, d, "part").groupBy("p_brand").count()
    return n.select("p_brand", scalar.pair_count(F.col("count").cast("double")).alias("pairs"))


# --- normalisation ---------------------------------------------------------------------------------------------------

_RPM = _each("{c}/(sum({c}) OVER ()/1e6) AS {c}")


@query("normalize_to_rpm", f"{_C} SELECT gene, {_each('round({c}/(sum({c}) OVER ()/1e6),6) AS {c}')} FROM counts")
def _(spark, d):
    return rounded(normalize.normalize_to_rpm(r.matrix(spark, d), "gene"))


@query("expressed_top_features", f"""{_C}, n AS (SELECT gene, {_RPM} FROM counts), f AS (SELECT *, {"+".join(S)} AS total FROM n
  WHERE {"+".join(f"CASE WHEN {c} >= 450 THEN 1 ELSE 0 END" for c in S)} >= 2)
  SELECT gene, {_each('round({c},6) AS {c}')}, round(total,6) AS total FROM (SELECT * FROM f ORDER BY total DESC, gene LIMIT 100)""")
def _(spark, d):
    rpm = normalize.normalize_to_rpm(r.matrix(spark, d), "gene")
    expressed = filters.filter_low_reads(rpm, "gene", 450, 2).withColumn("total", filters.row_sum(S))
    return rounded(sorting.filter_top_n(expressed, "gene", "total", 100, ascending=False))


@query("normalize_to_rpm_special_counters", f"""{_C}, x AS (SELECT 'n' AS k, {_each('sum({c}) AS {c}')} FROM counts)
  SELECT gene, {_each('round(counts.{c}/((x.{c}+x.{c}/4*3)/1e6),6) AS {c}')} FROM counts, x""")
def _(spark, d):
    c = r.matrix(spark, d)
    names = [*normalize.LIBRARY_COUNTERS, "__too_low_aQual"]
    special = c.agg(*[(F.sum(s) / 4).alias(s) for s in S]).withColumn("counter", F.explode(F.array(*map(F.lit, names))))
    return rounded(normalize.normalize_to_rpm_htseqcount(c, "gene", special, "counter"))


_LEN = "len AS (SELECT p_partkey AS gene, p_retailprice AS length FROM part)"


def _lengths(spark, d):
    return r.table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("length"))


@query("normalize_to_rpkm", f"""{_C}, {_LEN} SELECT gene, {_each('round({c}/((sum({c}) OVER ()/1e6)*(length/1000)),6) AS {c}')}
  FROM counts LEFT JOIN len USING (gene)""")
def _(spark, d):
    return rounded(normalize.normalize_to_rpkm(r.matrix(spark, d), "gene", _lengths(spark, d)))


@query("normalize_to_tpm", f"""{_C}, {_LEN}, q AS (SELECT gene, {_each('{c}/(length/1000) AS {c}')} FROM counts LEFT JOIN len USING (gene))
  SELECT gene, {_each('round({c}/(sum({c}) OVER ()/1e6),6) AS {c}')} FROM q""")
def _(spark, d):
    return rounded(normalize.normalize_to_tpm(r.matrix(spark, d), "gene", _lengths(spark, d)))


@query("normalize_to_quantile", f"""{_C}, z AS (SELECT * FROM counts WHERE greatest({_each('{c}')}) > 0),
  q AS (SELECT {_each('quantile_cont({c}, 0.75) AS {c}')} FROM z), m AS (SELECT ({"+".join(S)})/6 AS m FROM q)
  SELECT gene, {_each('round(counts.{c}/(q.{c}/m.m),6) AS {c}')} FROM counts, q, m""")
def _(spark, d):
    return rounded(normalize.normalize_to_quantile(r.matrix(spark, d), "gene"))


_MA_ROWS = " UNION ALL ".join(f"""SELECT gene, '{c}' AS sample, {c} AS raw, a_f AS rraw, {c}/(SELECT sum({c}) FROM used) AS x,
  a_f/(SELECT sum(a_f) FROM used) AS r FROM used""" for c in S)
_MA = f"""used AS (SELECT * FROM counts WHERE a_f > 0), rows AS ({_MA_ROWS}),
  ma AS (SELECT gene, sample, log2(x/r) AS m, log2(x*r)/2 AS a, 1/((1-x)/raw+(1-r)/rraw) AS weight FROM rows WHERE raw > 0)"""


@query("ma_table", f"{_C}, {_MA} SELECT gene, sample, round(m,6)+0.0 AS m, round(a,6) AS a FROM ma")
def _(spark, d):
    ma = normalize.ma_table(r.matrix(spark, d), "gene", S, "a_f").filter("m is not null")
    return rounded(ma.select("gene", "sample", "m", "a"))


@query("normalize_tmm", f"""{_C}, {_MA}, k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY m, gene) AS rm,
  row_number() OVER (PARTITION BY sample ORDER BY a, gene) AS ra, count(*) OVER (PARTITION BY sample) AS n FROM ma),
  f AS (SELECT sample, 2^(sum(m*weight)/sum(weight)) AS f FROM k WHERE rm > ceil(n*0.3) AND rm <= n-ceil(n*0.3)
    AND ra > ceil(n*0.05) AND ra <= n-ceil(n*0.05) GROUP BY sample),
  g AS (SELECT exp(avg(ln(f))) AS g FROM f), w AS (SELECT {_each("max(CASE WHEN sample='{c}' THEN f END)/max(g) AS {c}")} FROM f, g)
  SELECT gene, {_each('round(counts.{c}/w.{c},5) AS {c}')} FROM counts, w""")
def _(spark, d):
    return rounded(normalize.normalize_tmm(r.matrix(spark, d), "gene", ref="a_f"), digits=5)


@query("normalize_rle", f"""{_C}, p AS (SELECT *, exp(({"+".join(f"ln({c})" for c in S)})/6) AS g FROM counts WHERE least({_each('{c}')}) > 0),
  w AS (SELECT {_each('quantile_cont({c}/g, 0.5) AS {c}')} FROM p) SELECT gene, {_each('round(counts.{c}/w.{c},6) AS {c}')} FROM counts, w""")
def _(spark, d):
    return rounded(normalize.normalize_rle(r.matrix(spark, d), "gene"))


@query("normalize_median_of_ratios", f"""{_C}, t AS (SELECT {_each('sum({c}) AS {c}')} FROM counts),
  h AS (SELECT {", ".join("(" + "+".join(f"counts.{c}/t.{c}" for c in g) + f")/3 AS g{i}" for i, g in enumerate((r.F_SAMPLES, r.O_SAMPLES)))} FROM counts, t),
  q AS (SELECT quantile_cont(g0/g0, 0.5) AS m0, quantile_cont(g1/g0, 0.5) AS m1 FROM h WHERE g0 > 0),
  f AS (SELECT {", ".join(f"t.{c}*{'m0' if c in r.F_SAMPLES else 'm1'} AS {c}" for c in S)} FROM t, q),
  g AS (SELECT exp(({"+".join(f"ln({c})" for c in S)})/6) AS g FROM f)
  SELECT gene, {_each('round(counts.{c}/(f.{c}/g),6) AS {c}')} FROM counts, f, g""")
def _(spark, d):
    return rounded(normalize.normalize_median_of_ratios(r.matrix(spark, d), [r.F_SAMPLES, r.O_SAMPLES]))


@query("normalize_with_scaling_factors", f"{_C}, q AS (SELECT {_each('avg({c}) AS {c}')} FROM counts) SELECT gene, {_each('round(counts.{c}/q.{c},6) AS {c}')} FROM counts, q")
def _(spark, d):
    c = r.matrix(spark, d)
    return rounded(normalize.normalize_with_scaling_factors(c, "gene", c.agg(*[F.avg(s).alias(s) for s in S])))


@query("normalize_with_keyed_factors", f"{_C}, q AS (SELECT gene, {_each('{c}+1 AS {c}')} FROM counts WHERE a_f > 120) SELECT gene, {_each('round(counts.{c}/q.{c},6) AS {c}')} FROM counts LEFT JOIN q USING (gene)")
def _(spark, d):
    c = r.matrix(spark, d)
    keyed = c.filter("a_f > 120").select("gene", *[(F.col(s) + 1).alias(s) for s in S])
    return rounded(normalize.normalize_with_scaling_factors(c, "gene", keyed))


@query("normalize_event_counts_to_rpm", f"WITH {r.EVENT_COUNTS} SELECT gene, {_each('round({c}/(sum({c}) OVER ()/1e6),6) AS {c}', r.EVENT_SAMPLES)} FROM evc")
def _(spark, d):
    return rounded(normalize.normalize_to_rpm(r.event_counts(spark, d), "gene"))
