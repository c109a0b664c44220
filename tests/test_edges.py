"""Hot and null keys, torn pairs, record shapes, and tails far out."""

import json
import math

import pytest
from pyspark.sql import functions as F

from keyloom.functions import scalar, stats
from keyloom.operators import filters, ranking, reads, sets
from keyloom.operators.skew import grid, lookup
from keyloom.sources import annotations


def test_null_keys_are_spread(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id"))
        ref = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
        out = lookup(df, ref, ["k"], ref.limit(0))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 1.5 * 20_000 / len(sizes) and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert out.filter("v = 3 * k").count() == 10_000 and out.filter("k is null and v is null").count() == 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_grid_pairs_every_row(spark):
    a, b = spark.range(7).withColumnRenamed("id", "a"), spark.range(5).withColumnRenamed("id", "b")
    assert {tuple(r) for r in grid(a, b).collect()} == {(i, j) for i in range(7) for j in range(5)}
    assert grid(a, b.limit(0)).count() == 0


def _mate(name, flag, pos, quality):
    return ("s", name, flag, "c1", pos, 30, "10M", "=", 0, 0, "A" * 10, quality * 10, {})


def test_pairs_are_not_torn(spark):
    """Two pairs at one place, each with the better mate on another side: one pair stays whole."""
    rows = [_mate("a", 0x1 | 0x40, 100, "I"), _mate("a", 0x1 | 0x80 | 0x10, 200, "5"), _mate("b", 0x1 | 0x40, 100, "5"), _mate("b", 0x1 | 0x80 | 0x10, 200, "H"),
            _mate("c", 0x1 | 0x40, 100, "#"), _mate("c", 0x1 | 0x80 | 0x10, 300, "#"), _mate("u", 0x4, 0, "I"), _mate("v", 0x4, 0, "I")]
    table = spark.createDataFrame(rows, "sample string, qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, "
                                        "tlen long, seq string, qual string, tags map<string,string>")
    flags = {(r["qname"], r["pos"]): bool(r["flag"] & 0x400) for r in reads.find_duplicates(table).collect()}
    assert flags == {("a", 100): False, ("a", 200): False, ("b", 100): True, ("b", 200): True, ("c", 100): False, ("c", 300): False, ("u", 0): False, ("v", 0): False}
    assert {r["qname"] for r in reads.find_duplicates(table, "remove_all").collect()} == {"a", "c", "u", "v"}


def test_ortholog_records_in_both_shapes(spark, tmp_path):
    records = [{"type": "one-to-one", "orthologs": ["o1"], "inparalogs": ["p1"]}, {"type": "one-to-many", "orthologs": ["o2", "o3"], "inparalogs": ["p2"]}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, records)) + "\n")
    (tmp_path / "one.json").write_text(json.dumps({"data": records}, indent=1))
    want = {("one-to-one", ("o1",), ("p1",)), ("one-to-many", ("o2", "o3"), ("p2",))}
    for name in ("lines.json", "one.json"):
        got = annotations.read_ortholog_groups(spark, str(tmp_path / name)).collect()
        assert len(got) == 2 and {(r["type"], tuple(r["orthologs"]), tuple(r["inparalogs"])) for r in got} == want


def test_tails_far_out():
    n = 10_000_000_000
    for z in (0.5, 1.0, 3.0):
        k = int(n / 2 - z * math.sqrt(n) / 2)
        assert stats.sign_test_pvalue(k, n - k) == pytest.approx(math.erfc((n / 2 - k - 0.5) / math.sqrt(n / 4) / math.sqrt(2)), rel=1e-6)
    for n in (1, 2, 9, 40):
        for k in range(n + 1):
            exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2 ** n)
            assert stats.sign_test_pvalue(k, n - k) == pytest.approx(exact, rel=1e-12)
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, rel=1e-11)
    assert stats.t_two_sided(1.5, 1e6) == pytest.approx(math.erfc(1.5 / math.sqrt(2)), rel=1e-5)


def test_harmonic_numbers(spark):
    got = spark.createDataFrame([(m,) for m in (1, 2, 10, 1000, 1001, 50_000)], "m long").select("m", ranking.harmonic(F.col("m")).alias("h")).collect()
    for r in got:
        assert r["h"] == pytest.approx(math.fsum(1 / i for i in range(1, r["m"] + 1)), rel=1e-13)


def test_box_cox_beyond_the_first_bracket(spark):
    values = [(float(i), (20 + 0.5 * i / 100) ** 9 - 1) for i in range(100)]  # nearly linear in the ninth power, so lambda is far from 1
    df = spark.createDataFrame([(k, math.exp(math.exp(1 + 0.01 * i))) for k, (i, _) in enumerate(values)], "k int, x double")
    powers = scalar.box_cox_lambdas(df, ["x"], low=0.5, high=1.5)
    assert powers["x"] < 0.4 and powers["x"] == pytest.approx(scalar.box_cox_lambdas(df, ["x"])["x"], abs=1e-3)


def test_many_sets_and_zero_p_values(spark):
    operands = [spark.range(i, 80).withColumnRenamed("id", "gene") for i in range(70)]
    assert sets.intersection(operands, "gene").count() == 11
    assert {r["gene"] for r in sets.difference(operands[0], operands[1:], "gene").collect()} == {0}
    drawn = filters.volcano(spark.createDataFrame([(0.0, 2.0), (0.01, -2.0)], "padj double, log2FoldChange double"))
    assert [r["neg_log10_padj"] for r in drawn.collect()] == [math.inf, pytest.approx(2.0)]
