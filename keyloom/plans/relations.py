"""Feature tables derived from the bundled star schema, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint

SAMPLES = ["a_f", "a_o", "n_f", "n_o", "r_f", "r_o"]
F_SAMPLES, O_SAMPLES = SAMPLES[0::2], SAMPLES[1::2]
EVENT_SAMPLES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part x (return flag, line status) matrix of summed quantities."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("gene")).agg(*[
        F.sum(F.when((F.lower("l_returnflag") == s[0]) & (F.lower("l_linestatus") == s[2]), F.col("l_quantity"))
              .otherwise(0.0)).alias(s) for s in SAMPLES])


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count matrix, stored once for operators that pass over it more than once."""
    return checkpoint(counts(spark, sf_dir))


COUNTS = "counts AS (SELECT l_partkey AS gene, " + ", ".join(
    f"sum(CASE WHEN lower(l_returnflag)='{s[0]}' AND lower(l_linestatus)='{s[2]}' THEN l_quantity ELSE 0 END) AS {s}"
    for s in SAMPLES) + " FROM lineitem GROUP BY l_partkey)"


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User x event-type matrix of event counts."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("user_id").alias("gene")).agg(*[
        F.sum(F.when(F.col("event_type") == s, 1.0).otherwise(0.0)).alias(s) for s in EVENT_SAMPLES])


EVENT_COUNTS = "evc AS (SELECT user_id AS gene, " + ", ".join(
    f"sum(CASE WHEN event_type='{s}' THEN 1.0 ELSE 0.0 END)::DOUBLE AS {s}" for s in EVENT_SAMPLES
) + " FROM events GROUP BY user_id)"


def de_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A differential-expression shaped table per part; small parts have no adjusted p-value."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), "p_size")
    num, den = sum(F.col(s) for s in F_SAMPLES), sum(F.col(s) for s in O_SAMPLES)
    z2 = (num - den) * (num - den) / (num + den + 1)
    p = F.exp(-z2 / 2)
    return counts(spark, sf_dir).join(part, "gene").select(
        "gene", ((num + den) / 6).alias("baseMean"), F.log2((num / 3 + 1) / (den / 3 + 1)).alias("log2FoldChange"),
        p.alias("pvalue"), F.when(F.col("p_size") > 2, F.least(F.lit(1.0), p * 2)).alias("padj"))


_NUM, _DEN = "+".join(F_SAMPLES), "+".join(O_SAMPLES)
DE = COUNTS + f""", de0 AS (SELECT gene, p_size, ({_NUM}) AS num, ({_DEN}) AS den
  FROM counts JOIN part ON p_partkey = gene),
de AS (SELECT gene, (num+den)/6 AS "baseMean", log2((num/3+1)/(den/3+1)) AS "log2FoldChange",
  exp(-((num-den)*(num-den)/(num+den+1))/2) AS pvalue,
  CASE WHEN p_size > 2 THEN least(1.0, exp(-((num-den)*(num-den)/(num+den+1))/2)*2) END AS padj FROM de0)"""


def fold_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.aggregates import fold_change
    return fold_change(counts(spark, sf_dir), "gene", F_SAMPLES, O_SAMPLES, "fc")


FC = COUNTS + f", fcs AS (SELECT gene, (({_NUM})/3+1)/(({_DEN})/3+1) AS fc FROM counts)"


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long attribute table of parts: brand, type and size band."""
    part = table(spark, sf_dir, "part")
    band = F.concat(F.lit("size_"), F.floor(F.col("p_size") / 10).cast("string"))
    return part.select(F.col("p_partkey").alias("gene"), F.explode(F.array("p_brand", "p_type", band)).alias("attribute"))


ATTRIBUTES = """attrs AS (SELECT p_partkey AS gene, p_brand AS attribute FROM part
  UNION ALL SELECT p_partkey, p_type FROM part
  UNION ALL SELECT p_partkey, 'size_' || CAST(CAST(floor(p_size/10) AS BIGINT) AS VARCHAR) FROM part)"""


def target_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose reads lean clearly to one status."""
    return counts(spark, sf_dir).filter(F.abs(_lean()) >= 0.08).select("gene")


def _lean():
    num, den = sum(F.col(s) for s in F_SAMPLES), sum(F.col(s) for s in O_SAMPLES)
    return (num - den) / (num + den)


TARGET = f"target AS (SELECT gene FROM counts WHERE abs((({_NUM})-({_DEN}))/(({_NUM})+({_DEN}))) >= 0.08)"


def target_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two target sets in long form: parts leaning to either status."""
    return counts(spark, sf_dir).filter(F.abs(_lean()) >= 0.08).select(
        F.when(_lean() > 0, "toward_f").otherwise("toward_o").alias("set_id"), "gene")


TARGETS = (f"targets AS (SELECT CASE WHEN ({_NUM}) > ({_DEN}) THEN 'toward_f' ELSE 'toward_o' END AS set_id, gene "
           f"FROM counts WHERE abs((({_NUM})-({_DEN}))/(({_NUM})+({_DEN}))) >= 0.08)")
