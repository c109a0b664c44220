"""Per-feature models over the count matrix."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import designs, models, ranking
from ..session import checkpoint
from . import relations as r
from .registry import query, rounded

S = r.SAMPLES


def _design():
    return pd.DataFrame({"sample": S, "condition": ["f", "o"] * 3, "batch": ["a", "a", "n", "n", "r", "r"]})


_CPM = ", ".join(f"log2(({c}+0.5)/((SELECT sum({c}) FROM counts)+1)*1e6) AS {c}" for c in S)


_LOGS = f"""WITH {r.COUNTS}, l AS (SELECT gene, {_CPM} FROM counts)"""
_RLE = f"""WITH {r.COUNTS}, p AS (SELECT *, exp(({"+".join(f"ln({c})" for c in S)})/6) AS g FROM counts WHERE least({", ".join(S)}) > 0),
  w AS (SELECT {", ".join(f"quantile_cont({c}/g, 0.5) AS {c}" for c in S)} FROM p)"""
_BASE = f"""{_RLE} SELECT gene, round(({"+".join(f"round_even(counts.{c}, 0)/w.{c}" for c in S)})/6, 5) AS base, true AS sound FROM counts, w WHERE greatest({", ".join(f"counts.{c}" for c in S)}) > 0"""


def _adjusted(df):
    """Benjamini-Hochberg from the returned p-values agrees with the returned adjusted ones, both inside [0, 1]."""
    again = ranking.fdr_adjust(checkpoint(df).drop("padj"), "pvalue", name="again").select("gene", "again")
    return df.join(again, "gene").withColumn("adjusted", F.col("pvalue").isNull() | (
        F.col("pvalue").between(0, 1) & (F.abs(F.col("padj") - F.col("again")) < 1e-9) & (F.col("padj") >= F.col("pvalue") * (1 - 1e-12))))


def _voom() -> str:
    """The mean-variance trend of a two-group design (``trend``: place, x, y): root deviations against mean log counts, LOWESS at 101 anchors."""
    two = {"f": [c for c in S if c.endswith("f")], "o": [c for c in S if c.endswith("o")]}
    mean = {g: "(" + "+".join(cs) + f")/{len(cs)}" for g, cs in two.items()}
    shift = "(" + "+".join(f"log2((SELECT sum({c}) FROM counts)+1)" for c in S) + ")/6 - log2(1e6)"
    tricube = "CASE WHEN abs(x-a) <= 0.001*h THEN 1.0 WHEN abs(x-a) <= 0.999*h THEN (1-(abs(x-a)/h)^3)^3 ELSE 0.0 END"
    steps = [f"""fits AS MATERIALIZED (SELECT *, {mean['f']} AS mf, {mean['o']} AS mo FROM l),
  pts AS MATERIALIZED (SELECT gene, x, y FROM (SELECT gene, ({"+".join(S)})/6 + {shift} AS x, (({"+".join(f"({c}-m{g})^2" for g, cs in two.items() for c in cs)})/4)^0.25 AS y FROM fits) WHERE y > 0),
  ends AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM pts),
  grid AS (SELECT i, lo + (hi-lo)*i/100.0 AS a FROM ends, range(101) t(i)),
  reach AS MATERIALIZED (SELECT i, a, list_sort(list(abs(x-a)))[greatest(2, floor(0.5*any_value(n)+1e-7)::BIGINT)] AS h FROM grid, pts, ends GROUP BY i, a),
  rob0 AS (SELECT gene, x, y, 1.0::DOUBLE AS rb FROM pts)"""]
    for k in range(4):
        steps.append(f"""sums{k} AS (SELECT i, a, sum(w) AS s0, sum(w*u)/sum(w) AS m, sum(w*u*u)/sum(w) AS uu, sum(w*y)/sum(w) AS my, sum(w*u*y)/sum(w) AS uy
    FROM (SELECT i, a, y, x-a AS u, ({tricube})*rb AS w FROM rob{k}, reach) GROUP BY i, a),
  fit{k} AS MATERIALIZED (SELECT i, a, CASE WHEN sqrt(greatest(uu-m*m, 0)) > 0.001*(hi-lo) THEN my - (uy-m*my)/(uu-m*m)*m ELSE my END AS y FROM sums{k}, ends)""")
        if k < 3:
            steps.append(f"""res{k} AS MATERIALIZED (SELECT p.gene, p.x, p.y, abs(p.y - (f.y + (g.y-f.y)*(p.x-f.a)/(g.a-f.a))) AS r FROM
    (SELECT *, least(99, floor((x-lo)/(hi-lo)*100))::BIGINT AS i FROM pts, ends) p JOIN fit{k} f ON f.i = p.i JOIN fit{k} g ON g.i = p.i + 1),
  rob{k + 1} AS (SELECT gene, x, y, CASE WHEN r <= 0.001*c THEN 1.0 WHEN r <= 0.999*c THEN (1-(r/c)^2)^2 ELSE 0.0 END AS rb FROM res{k}, (SELECT 6*quantile_cont(r, 0.5) AS c FROM res{k}))""")
    return ", ".join(steps)


@query("mean_variance_trend", f"{_LOGS}, {_voom()} SELECT i AS place, round(a, 6) AS x, round(y, 6) AS y FROM fit3")
def _(spark, d):
    """The trend of the precision weights, anchor by anchor."""
    m = r.matrix(spark, d)
    table = designs.check_design(_design(), S)
    at, fitted = models.voom_trend(m, "gene", S, table, ["condition"])
    rows = spark.createDataFrame([(i, float(a), float(y)) for i, (a, y) in enumerate(zip(at, fitted))], "place long, x double, y double")
    return rounded(rows)


_CELLS = " UNION ALL ".join(f"SELECT gene, '{c[-1]}' AS grp, {c} AS y, m{c[-1]} + log2((SELECT sum({c}) FROM counts)+1) - log2(1e6) AS pos FROM fits" for c in S)


# Weights from the trend, weighted means of both groups, the prior variance where the variances vary no more than by chance (all degrees of freedom are
# the prior's then), and the normal tail by Simpson's rule.
@query("limma_voom", f"""{_LOGS}, {_voom()}, cells AS ({_CELLS}), placed AS (SELECT c.*, least(99, greatest(0, floor((pos-lo)/(hi-lo)*100)))::BIGINT AS i, least(hi, greatest(lo, pos)) AS x FROM cells c, ends),
  weighed AS MATERIALIZED (SELECT p.gene, grp, p.y, greatest(f.y + (g.y-f.y)*(x-f.a)/(g.a-f.a), 1e-8)^(-4) AS w FROM placed p JOIN fit3 f ON f.i = p.i JOIN fit3 g ON g.i = p.i + 1),
  grp AS (SELECT gene, grp, sum(w*y)/sum(w) AS m, sum(w) AS sw FROM weighed GROUP BY 1, 2),
  est AS (SELECT f.gene, f.m - o.m AS lfc, 1/f.sw + 1/o.sw AS cov, v.var FROM grp f JOIN grp o ON o.gene = f.gene AND o.grp = 'o' AND f.grp = 'f'
    JOIN (SELECT w.gene, sum(w.w*(w.y-g.m)^2)/4 AS var FROM weighed w JOIN grp g USING (gene, grp) GROUP BY 1) v ON v.gene = f.gene),
  prior AS (SELECT exp(avg(ln(var)) - {1 - 0.5772156649015329} + ln(2.0::DOUBLE)) AS s0, var_samp(ln(var)) - {1.6449340668482264 - 1} AS excess FROM est WHERE var > 0),
  tested AS (SELECT gene, lfc, lfc/sqrt(cov*s0) AS t FROM est, prior WHERE excess <= 0),
  tails AS (SELECT gene, sum(CASE WHEN k IN (0, 1200) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(0-(abs(t)+k/100.0)^2/2)) * 0.01/3 * 2/sqrt(2*pi()) AS p FROM tested, range(1201) r(k) GROUP BY gene)
  SELECT gene, round(({'+'.join(S)})/6, 6) AS ave, round(lfc, 6) + 0.0 AS lfc, round(t, 5) + 0.0 AS stat, round(p, 6) AS pvalue, true AS adjusted FROM tested JOIN tails USING (gene) JOIN l USING (gene)""")
def _(spark, d):
    res = checkpoint(models.limma_voom(r.matrix(spark, d), "gene", S, _design(), [("condition", "f", "o")], model_factors=["condition"])["condition_f_vs_o"])
    out = _adjusted(res).select("gene", F.col("AveExpr").alias("ave"), F.col("logFC").alias("lfc"), "stat", "pvalue", "adjusted")
    return rounded(rounded(out, ["ave", "lfc", "pvalue"]), ["stat"], 5)


@query("limma_voom_factor_test", f"{_LOGS} SELECT gene, round(({'+'.join(S)})/6,6) AS ave, true AS sound FROM l")
def _(spark, d):
    res = checkpoint(models.limma_voom(r.matrix(spark, d), "gene", S, _design(), lrt_factors=["batch"])["LRT_batch"])
    return rounded(_adjusted(res).select("gene", F.col("AveExpr").alias("ave"), (F.col("adjusted") & (F.col("stat") >= 0)).alias("sound")))


@query("deseq2_wald", _BASE)
def _(spark, d):
    """Mean normalised counts, and a statistic that is the fold change over its error."""
    res = checkpoint(models.deseq2(r.matrix(spark, d), "gene", S, _design(), [("condition", "f", "o")], model_factors=["condition"])["condition_f_vs_o"])
    sound = F.col("adjusted") & (F.abs(F.col("stat") * F.col("lfcSE") - F.col("log2FoldChange")) < 1e-6) & (F.col("lfcSE") > 0)
    return rounded(_adjusted(res).select("gene", F.col("baseMean").alias("base"), sound.alias("sound")), digits=5)


@query("deseq2_likelihood_ratio", _BASE)
def _(spark, d):
    res = checkpoint(models.deseq2(r.matrix(spark, d), "gene", S, _design(), lrt_factors=["condition"])["LRT_condition"])
    return rounded(_adjusted(res).select("gene", F.col("baseMean").alias("base"), (F.col("adjusted") & (F.col("stat") >= 0)).alias("sound")), digits=5)


@query("linear_model_effects", f"""WITH {r.COUNTS}, l AS (SELECT gene, {_CPM} FROM counts) SELECT gene,
  round((a_f+n_f+r_f)/3-(a_o+n_o+r_o)/3,6)+0.0 AS effect, round(({"+".join(S)})/6,6) AS ave FROM l""")
def _(spark, d):
    """Unweighted effects have a closed form, which checks the model matrix and the batch solver."""
    import numpy as np
    table = designs.check_design(_design(), S)
    x, names = designs.model_matrix(table, ["condition"])
    c = designs.contrast(table, names, "condition", "f", "o")
    m = r.matrix(spark, d)
    lib = np.array([v + 1 for v in models.column_sums(m, S).values()])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.log2((np.stack(pdf["y"].to_numpy()) + 0.5) / lib * 1e6)
        beta, _, _ = models._weighted_fit(y, np.ones_like(y), x)
        return pd.DataFrame({"gene": pdf["gene"], "effect": beta @ c, "ave": y.mean(1)})

    return rounded(models._map(models._values(m, "gene", S), fit, "gene long, effect double, ave double"))
