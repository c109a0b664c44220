import itertools
import math
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions import stats
from keyloom.operators import enrichment as en
from keyloom.operators import ontology as onto
from keyloom.session import checkpoint
from keyloom.table import FeatureSet

TERMS = {
    "GO:0008150": [1, 2, 3, 4, 6, 7, 9, 12, 13, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 27, 28, 29],
    "GO:0050896": [1, 2, 3, 4, 6, 7, 9, 12, 13, 15, 16, 17, 19, 20, 21, 22, 23, 24, 25, 27, 28, 29],
    "GO:0009605": [1, 2, 3, 4, 6, 7, 9, 12, 13, 15, 16, 17, 19, 20, 23, 25, 27, 28],
    "GO:0009991": [1, 2, 3, 4, 7, 9, 12, 13, 15, 16, 17, 19, 20, 23, 25, 27, 28],
    "GO:0007610": [2, 3, 7, 12, 17, 18, 19, 25, 27, 28],
    "GO:0031667": [1, 2, 3, 4, 7, 12, 13, 15, 16, 19, 20, 23, 24, 25, 27, 28],
    "GO:0007584": [2, 3, 7, 12, 13, 15, 19, 20, 23, 24, 25, 27, 28],
    "GO:0042221": [2, 3, 7, 12, 13, 15, 19, 20, 21, 22, 23, 24, 25, 27, 28, 29],
    "GO:0051780": [2, 3, 7, 12, 19, 25, 27, 28],
    "GO:0098772": [1, 2, 5, 8, 10, 11, 14, 17, 23, 26, 27, 29, 30],
}
IS_A = [("GO:0050896", "GO:0008150"), ("GO:0009605", "GO:0050896"), ("GO:0009991", "GO:0009605"), ("GO:0042221", "GO:0050896"),
        ("GO:0007610", "GO:0008150"), ("GO:0031667", "GO:0009991"), ("GO:0007584", "GO:0031667"), ("GO:0007584", "GO:0042221"),
        ("GO:0051780", "GO:0007584"), ("GO:0051780", "GO:0007610")]
TARGETS = [1, 2, 5, 12, 13, 17, 19, 25, 27, 28]
CLASSIC = {"GO:0008150": 0.22847038, "GO:0050896": 0.153969169, "GO:0009605": 0.020875277, "GO:0009991": 0.011165846,
           "GO:0007610": 0.004844431, "GO:0031667": 0.044577711, "GO:0007584": 0.045077461, "GO:0042221": 0.183175079,
           "GO:0051780": 0.007234844, "GO:0098772": 0.446076962}
ELIM = {"GO:0008150": 0.57117595, "GO:0050896": 0.673613743, "GO:0009605": 0.560339411, "GO:0009991": 0.656391385,
        "GO:0007610": 0.563218391, "GO:0031667": 0.451974013, "GO:0007584": 0.448781104, "GO:0042221": 0.153969169,
        "GO:0051780": 0.007234844, "GO:0098772": 0.446076962}
WEIGHT = {"GO:0009605": 1, "GO:0009991": 1, "GO:0007610": 0.004844431, "GO:0031667": 1, "GO:0007584": 1}


@pytest.fixture(scope="module")
def go(spark):
    rows = checkpoint(spark.createDataFrame([(t, f"gene{g}") for t, gs in TERMS.items() for g in gs], "term string, key string"))
    targets = spark.createDataFrame([("set", f"gene{g}") for g in TARGETS], "set_id string, key string")
    background = spark.createDataFrame([(f"gene{i + 1}",) for i in range(30)], "key string")
    edges = spark.createDataFrame(IS_A, "child string, parent string")
    nodes = onto.levels(spark.createDataFrame([(t,) for t in TERMS], "term string"), edges)
    params = checkpoint(en.set_parameters(rows.withColumnRenamed("term", "attribute"), targets, "key", background))
    return rows, targets, edges, nodes, params


def test_classic_golden(go):
    *_, params = go
    fn = en._row_test(stats.hypergeometric_pvalue)
    got = {r["attribute"]: r["p"] for r in params.select("attribute", fn("population", "draws", "successes", "hits").alias("p")).collect()}
    assert got == pytest.approx(CLASSIC, rel=1e-6)


def test_elim_golden(go):
    rows, targets, edges, nodes, params = go
    res = en._elim(params, rows, targets, "key", nodes, onto.ancestors(edges), en._row_test(stats.hypergeometric_pvalue), 0.2)
    assert {r["attribute"]: r["pval"] for r in res.collect()} == pytest.approx(ELIM, rel=1e-6)


def test_weight_against_golden_subset(go):
    rows, targets, edges, nodes, params = go
    fisher = en._row_test(stats.fisher_pvalue)
    got = {r["attribute"]: r["pval"] for r in en._weight(params, rows, targets, "key", nodes, edges, onto.ancestors(edges), fisher).collect()}
    for term, want in WEIGHT.items():
        assert got[term] == pytest.approx(want, rel=1e-6)


def test_alike_keys_are_tested_as_one_row(spark):
    """60 keys of four kinds, a key without a term, one outside the ontology and null keys: the same p-values as key by key, from four rows."""
    edges = spark.createDataFrame([("leaf", "root"), ("twin", "root")], "child string, parent string")
    nodes = spark.createDataFrame([("root", 0), ("leaf", 1), ("twin", 1)], "term string, level int")
    direct = [("leaf" if i % 2 else "twin", i) for i in range(60)]
    odd = [(None, 90), ("elsewhere", 91), ("leaf", None), ("leaf", 1)]
    ann = spark.createDataFrame(direct + odd, "term string, key long")
    chosen = [i for i in range(60) if i % 2 and i < 30 or i % 2 == 0 and i >= 50]
    targets = spark.createDataFrame([("set", i) for i in (*chosen, 90, 91, 99)], "set_id string, key long")
    rows, sets, kinds = en._alike(ann, targets, "key")
    assert sorted(r["n"] for r in kinds.collect()) == [1, 5, 15, 15, 25] and rows.count() == 5 and sets.count() == 3
    every = checkpoint(spark.createDataFrame(direct + [("root", i) for i in range(60)], "term string, key long"))
    own = checkpoint(spark.createDataFrame([("set", i) for i in chosen], "set_id string, key long"))
    params = checkpoint(en.set_parameters(every.withColumnRenamed("term", "attribute"), own, "key", every.select("key").distinct()))
    closure, fisher = onto.ancestors(edges), en._row_test(stats.fisher_pvalue)
    for how, apart in (("elim", en._elim(params, every, own, "key", nodes, closure, fisher, 0.05)), ("weight", en._weight(params, every, own, "key", nodes, edges, closure, fisher))):
        want = {r["attribute"]: r for r in apart.collect()}
        got = {r["name"]: r for r in en.ontology_enrichment(ann, targets, "key", nodes, edges, propagate=how).collect()}
        assert {t: (r["pval"], r["samples"], r["obs"]) for t, r in got.items()} == {t: (pytest.approx(r["pval"]), r["draws"], r["hits"]) for t, r in want.items()}


def test_combined_is_geometric_mean(go):
    rows, targets, edges, nodes, params = go
    fisher = en._row_test(stats.fisher_pvalue)
    closure = onto.ancestors(edges)
    parts = [params.withColumn("pval", fisher("population", "draws", "successes", "hits")),
             en._elim(params, rows, targets, "key", nodes, closure, fisher, 0.05), en._weight(params, rows, targets, "key", nodes, edges, closure, fisher)]
    tables = [{r["attribute"]: r["pval"] for r in p.collect()} for p in parts]
    for r in en._combine(*parts).collect():
        assert r["pval"] == pytest.approx(math.prod(t[r["attribute"]] for t in tables) ** (1 / 3))


def test_tail_kernels_against_sums():
    for n, k, draws in itertools.product((12, 38), range(0, 13, 3), range(1, 12, 3)):
        low, high = max(0, draws + k - n), min(k, draws)
        pmf = {i: comb(k, i) * comb(n - k, draws - i) / comb(n, draws) for i in range(low, high + 1)}
        for hits, p in pmf.items():
            two_sided = sum(v for v in pmf.values() if v <= p * (1 + 1e-7))
            assert stats.fisher_pvalue(n, draws, k, hits) == pytest.approx(two_sided, abs=1e-12)
            one = sum(v for i, v in pmf.items() if (i <= hits if hits / draws < k / n else i >= hits))
            assert stats.hypergeometric_pvalue(n, draws, k, hits) == pytest.approx(one, abs=1e-12)


def test_known_distribution_values():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.0733880348)
    assert stats.chi2_upper(3.84, 1) == pytest.approx(0.0500435212)
    assert stats.f_upper(3.0, 2, 10) == pytest.approx(0.0953674316)
    assert stats.sign_test_pvalue(8, 2) == pytest.approx(0.109375)
    assert stats.trigamma_inverse(stats.trigamma(3.3)) == pytest.approx(3.3)


def test_attribute_golden(spark):
    """38 genes in the background, 10 targets: 8 of 11 and 1 of 8 carry the attributes."""
    rows, targets = [], [("set", i) for i in range(10)]
    rows += [("attribute1", i) for i in [*range(8), 20, 21, 22]]
    rows += [("attribute2", i) for i in [9, *range(25, 32)]]
    rows += [("everything", i) for i in range(38)]
    ann = spark.createDataFrame(rows, "attribute string, key long")
    res = {r["name"]: r for r in en.enrichment(ann, spark.createDataFrame(targets, "set_id string, key long"), "key",
                                              test="hypergeometric").collect()}
    assert res["attribute1"]["pval"] == pytest.approx(0.0001256753917949536)
    assert res["attribute1"]["exp"] == pytest.approx(2.894736842)
    assert res["attribute1"]["log2_fold_enrichment"] == pytest.approx(1.4665678)
    assert res["attribute2"]["pval"] == pytest.approx(0.30567357030455)
    assert res["attribute1"]["significant"] and not res["attribute2"]["significant"]


def test_permutation_close_to_hypergeometric(spark):
    ann = spark.createDataFrame([("a", i) for i in range(30)] + [("all", i) for i in range(100)], "attribute string, key long")
    targets = spark.createDataFrame([("set", i) for i in range(0, 40, 2)], "set_id string, key long")
    exact = {r["name"]: r["pval"] for r in en.enrichment(ann, targets, "key", test="hypergeometric").collect()}
    drawn = {r["name"]: r["pval"] for r in en.enrichment(ann, targets, "key", test="randomization", reps=20000, seed=1).collect()}
    assert drawn["a"] == pytest.approx(exact["a"], abs=0.02)


def test_single_list_pvalue_against_enumeration(spark):
    n, k, x, lowest = 10, 4, 2, 6

    def stat(pos):
        tails = [stats.hypergeom_sf(j - 1, n, k, c) for c in range(1, lowest + 1) if (j := sum(p < c for p in pos)) >= x]
        return min(tails, default=1.0)

    every = {pos: stat(pos) for pos in itertools.combinations(range(n), k)}
    for s in sorted(set(every.values())):
        want = sum(v <= s * (1 + 1e-12) for v in every.values()) / len(every) if s < 1 else 1.0
        assert stats.xl_mhg_pvalue(n, k, x, lowest, s) == pytest.approx(want, abs=1e-12)
    ranked = spark.createDataFrame([(i, i) for i in range(100)], "key long, rank long")
    ann = spark.createDataFrame([("top", i) for i in range(12)] + [("bottom", i) for i in range(88, 100)]
                                + [("spread", i) for i in range(0, 100, 8)], "attribute string, key long")
    res = {r["name"]: r for r in en.ranked_enrichment(ann, ranked, "key", min_positive=5).collect()}
    assert res["top"]["significant"] and res["top"]["log2_enrichment_score"] > 0
    assert res["bottom"]["significant"] and res["bottom"]["log2_enrichment_score"] < 0
    assert not res["spread"]["significant"]


def test_terms_of_a_ranked_list_lose_the_keys_of_significant_descendants(spark):
    """leaf and its twin are at the top; mid has them and ten spread keys; root has all; low is at the bottom, which takes nothing away."""
    ranked = spark.createDataFrame([(i, i) for i in range(120)], "key long, rank long")
    direct = [("leaf", i) for i in range(12)] + [("twin", i) for i in range(6, 18)] + [("mid", i) for i in range(20, 120, 10)] + [
        ("low", i) for i in range(108, 120)] + [("root", i) for i in range(120)] + [("lost", 3)]
    nodes = spark.createDataFrame([("root", 0), ("mid", 1), ("low", 1), ("only", 1), ("leaf", 2), ("twin", 2), ("lost", 2)], "term string, level int")
    edges = spark.createDataFrame([("leaf", "mid"), ("leaf", "only"), ("twin", "mid"), ("mid", "root"), ("only", "root"), ("low", "root")], "child string, parent string")
    ann = spark.createDataFrame(direct + direct[:5], "term string, key long")

    def run(how):
        return {r["name"]: r for r in en.ranked_ontology_enrichment(ann, ranked, "key", nodes, edges, propagate=how, min_positive=5).collect()}

    elim, classic, plain = run("elim"), run("classic"), run("no")
    kept = spark.createDataFrame([("mid", i) for i in range(20, 120, 10)] + [("root", i) for i in range(18, 120)] + [("all", i) for i in range(120)], "attribute string, key long")
    rest = {r["name"]: r["pval"] for r in en.ranked_enrichment(kept, ranked, "key", min_positive=5).collect()}
    assert set(elim) == set(classic) == {"root", "mid", "low", "only", "leaf", "twin", "lost"} and set(plain) == set(elim) - {"only"}
    assert all(elim[t]["pval"] == classic[t]["pval"] for t in ("leaf", "twin", "low", "lost"))
    assert elim["mid"]["pval"] == pytest.approx(rest["mid"]) and elim["root"]["pval"] == pytest.approx(rest["root"])
    assert classic["leaf"]["log2_enrichment_score"] == pytest.approx(math.log2(10))  # all of its keys come first: rounding takes no cutoff out
    assert classic["mid"]["significant"] and not elim["mid"]["significant"] and classic["only"]["significant"]
    assert (elim["only"]["pval"], elim["only"]["obs"], elim["only"]["log2_enrichment_score"]) == (1.0, 0, 0.0)
    assert all(elim[t]["samples"] == 120 and elim[t]["padj"] >= elim[t]["pval"] for t in elim)
    assert en.ranked_ontology_enrichment(ann.filter("false"), ranked, "key", nodes, edges).collect() == []
    with pytest.raises(ValueError):
        run("weight")


def test_fold_change_randomization(spark):
    ref = spark.range(400).select(F.col("id").alias("gene"), (F.col("id") / 100).alias("fc"))
    high = en.fold_change_randomization(ref.filter("gene >= 380"), ref, "gene", "fc", reps=500, seed=2).first()
    middle = en.fold_change_randomization(ref.filter("gene % 20 = 10"), ref, "gene", "fc", reps=500, seed=2, bucket_rows=30).first()
    assert high["significant"] and high["pval"] == pytest.approx(1 / 501)
    assert not middle["significant"] and 0.3 < middle["pval"] < 0.7
    # the same draws however the rows are dealt, also where rows repeat
    again = en.fold_change_randomization(ref.filter("gene % 20 = 10").repartition(3), ref.repartition(7), "gene", "fc", reps=500, seed=2, bucket_rows=30).first()
    assert tuple(again) == tuple(middle)
    alike = spark.range(300).select(F.lit(1).alias("gene"), F.when(F.col("id") < 200, 1.0).otherwise(3.0).alias("fc"))
    even = en.fold_change_randomization(alike.filter("fc > 1").limit(10), alike, "gene", "fc", reps=2000, seed=1, bucket_rows=40).first()
    assert even["pval"] < 0.002  # ten of 100 among 300: 1.2e-5


def test_random_subsets_are_uniform(spark):
    """All 20 subsets of three among six rows, drawn through a tree of several leaves."""
    ref = spark.createDataFrame([(i, float(2 ** i)) for i in range(6)], "gene long, fc double")
    sums = [2 ** a + 2 ** b + 2 ** c for a, b, c in itertools.combinations(range(6), 3)]
    for seed, ids in ((4, (2, 3, 4)), (5, (0, 1, 5)), (6, (3, 4, 5))):
        got = en.fold_change_randomization(ref.filter(F.col("gene").isin(*ids)), ref, "gene", "fc", reps=6000, seed=seed, bucket_rows=2).first()
        mean = sum(2 ** i for i in ids)
        want = sum(s >= mean for s in sums) / 20 if mean > 31.5 else sum(s <= mean for s in sums) / 20
        assert got["pval"] == pytest.approx(want, abs=4 * (want / 6000) ** 0.5 + 1 / 6000)


def test_shares_of_a_reference_of_two_billion_rows():
    path = [{"left": 1_100_000_000, "total": 2_000_000_000}, {"left": 500_000_000, "total": 1_100_000_000}]
    shares = {leaf: en._shares(3, leaf, path if leaf < 2 else [path[0], {"left": 450_000_000, "total": 900_000_000}], 4000, 3000) for leaf in range(4)}
    assert (sum(shares.values()) == 4000).all()
    assert shares[0].mean() == pytest.approx(1000, abs=2.5) and shares[0].std() == pytest.approx((4000 * 0.25 * 0.75) ** 0.5, rel=0.06)
    # the two ways of drawing agree where both apply
    rng = np.random.default_rng(0)
    small = rng.hypergeometric(600_000_000, 300_000_000, 900, 20_000)
    large = en._hypergeometric(rng, 700_000_000, 350_000_000, np.full(20_000, 900))
    assert large.mean() == pytest.approx(small.mean(), abs=0.5) and large.std() == pytest.approx(small.std(), rel=0.03)


def walked_mhg(n, k_total, min_hits, lowest, stat):
    """The p-value by all cutoffs one after another."""
    alive = np.zeros(k_total + 2)
    alive[0] = 1.0
    hits = np.arange(k_total + 1)
    for cutoff in range(1, lowest + 1):
        move = alive[:-1] * np.clip((k_total - hits) / (n - cutoff + 1), 0, 1)
        alive[:-1] -= move
        alive[1:] += move
        for h in range(min_hits, min(cutoff, k_total) + 1):
            if stats.hypergeom_sf(h - 1, n, k_total, cutoff) <= stat * (1 + 1e-11):
                alive[h:] = 0
                break
    return 1 - alive.sum()


def test_ranked_list_pvalue_of_longer_lists():
    for n, k, x, lowest, s in ((200, 20, 3, 60, 0.01), (300, 90, 10, 75, 1e-3), (150, 130, 1, 150, 0.05), (250, 5, 1, 100, 0.3)):
        assert stats.xl_mhg_pvalue(n, k, x, lowest, s) == pytest.approx(walked_mhg(n, k, x, lowest, s), abs=1e-11)
    # of all paths only the one with every hit in front: exact where one minus the rest would be nothing
    tiny = stats.hypergeom_sf(29, 5000, 30, 30)
    assert stats.xl_mhg_pvalue(5000, 30, 30, 1250, tiny) == pytest.approx(tiny, rel=1e-8)


def test_ranked_list_pvalue_of_ten_million_keys():
    import resource
    import time
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    p = stats.xl_mhg_pvalue(10_000_000, 1000, 10, 2_500_000, 1e-4)
    assert 1e-4 <= p <= 0.1
    assert time.perf_counter() - start < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kB


def test_numeric_missing_target_value(spark):
    values = spark.createDataFrame([("v", i, float(i)) for i in range(20)] + [("w", i, None if i == 3 else float(i)) for i in range(20)],
                                   "attribute string, key long, value double")
    fs = FeatureSet.from_ids(spark, [1, 2, 3, 4])
    for parametric in (True, False):
        res = {r["name"]: r for r in fs.non_categorical_enrichment(values, parametric=parametric).collect()}
        assert res["w"]["pval"] is None and res["w"]["padj"] is None and not res["w"]["significant"]
        assert res["v"]["pval"] is not None


def test_levels_and_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c")], "child string, parent string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "term string")
    assert {r["term"]: r["level"] for r in onto.levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {(r[0], r[1]) for r in onto.ancestors(edges).collect()} == {("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("d", "b"), ("d", "a")}


def test_mhg_pvalue_of_a_long_list_with_a_large_set():
    """Tens of thousands of cutoffs: a sum for each of them and a step for all hits take minutes."""
    import time
    start = time.process_time()
    p = stats.xl_mhg_pvalue(300_000, 60_000, 10, 75_000, 0.01)
    assert 0.01 < p < 0.5 and time.process_time() - start < 15
    n, k, lowest = 2600, 700, 160
    for s in (1e-2,):
        assert stats.xl_mhg_pvalue(n, k, 10, lowest, s) == pytest.approx(walked_mhg(n, k, 10, lowest, s), abs=1e-11)


def test_paths_of_long_lists_are_folded_by_their_counts(monkeypatch):
    """Wide bands of hits go on by one product with the ways to draw; it gives what the band of each number of hits gives."""
    folded, by_counts = [], stats._hits_by_counts

    def watched(*args):
        folded.append(len(args[0]) * args[-1])
        return by_counts(*args)
    monkeypatch.setattr(stats, "_hits_by_counts", watched)
    quick = stats.xl_mhg_pvalue(200_000, 40_000, 10, 50_000, 0.003)
    assert sum(folded) > 1_000_000
    monkeypatch.setattr(stats, "_hits_by_counts", lambda *args: None)
    assert quick == pytest.approx(stats.xl_mhg_pvalue(200_000, 40_000, 10, 50_000, 0.003), rel=1e-12)
    for size, *args in ((40, 3, 900, 300, 30, 30), (70, 30, 5000, 900, 300, 200)):
        alive = np.random.default_rng(2).random(size)
        alive /= alive.sum()
        near = stats._hits_later(np.concatenate([np.zeros(args[0]), alive]), *args[1:4])
        got = by_counts(alive, *args)
        least = min(len(got), len(near))
        assert got.sum() == pytest.approx(1.0) and got[:least] == pytest.approx(near[:least], abs=1e-14)


@pytest.mark.parametrize("draws", [1, 5, 64, 65])
def test_few_draws_are_followed_one_by_one(draws):
    alive = np.random.default_rng(draws).random(30)
    alive /= alive.sum()
    want = stats._hits_later(np.concatenate([np.zeros(12), alive]), 700, 130, draws)[12:]
    got = stats._hits_soon(alive, 12, 700, 130, draws)
    size = min(len(want), len(got))
    assert got[:size] == pytest.approx(want[:size], abs=1e-14) and got[size:].sum() < 1e-14
