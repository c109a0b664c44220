import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyloom.functions import adapters, distance
from keyloom.operators import cluster, designs, graphs, models, pca, reads, skew
from keyloom.sources import reads as sam
from conftest import rows


def naive_three_prime(read, adapter, rate, overlap):
    """All alignments of adapter prefixes with read parts that end at the adapter's or the read's end."""
    best, n, m = None, len(read), len(adapter)
    for s in range(n):
        table = {(0, 0): (0, 0)}
        for i in range(m + 1):
            for j in range(n - s + 1):
                options = []
                if i and j:
                    c, k = table[i - 1, j - 1]
                    miss = read[s + j - 1] != adapter[i - 1]
                    options.append((c + miss, k - (not miss)))
                if i:
                    c, k = table[i - 1, j]
                    options.append((c + 1, k))
                if j:
                    c, k = table[i, j - 1]
                    options.append((c + 1, k))
                if options:
                    table[i, j] = min(options)
                if i >= overlap and j and (i == m or s + j == n) and table[i, j][0] <= int(rate * i):
                    cand = (table[i, j][1], table[i, j][0])
                    best = cand if best is None or cand < best else best
    return best


def test_adapter_search_against_naive():
    rng = random.Random(3)
    adapter = "ACGTTCAGGA"
    texts = []
    for i in range(60):
        body = "".join(rng.choice("ACGT") for _ in range(rng.randint(4, 24)))
        part = (adapter, adapter[:4] + adapter[5:], adapter[:6], "")[i % 4]
        texts.append(body + part + (body[:3] if i % 3 == 0 else ""))
    start, match, err = adapters.search_three_prime(texts, adapter, 0.2, 3, width=16)
    for i, t in enumerate(texts):
        want = naive_three_prime(t, adapter, 0.2, 3)
        assert (None if start[i] < 0 else (-match[i], err[i])) == want


def test_trim_reads(spark):
    df = spark.createDataFrame([("s", "a", "TTTTACGTACCGTAGG", "I" * 16), ("s", "b", "TTTTTTTT", "I" * 8), ("s", "c", "CCACGTAC", "I" * 8)],
                               "sample string, read_id string, seq string, qual string")
    out = reads.trim_adapters(df, three_prime=["ACGTACCGTA"])
    assert {r["read_id"]: (r["seq"], len(r["qual"]), r["trimmed"]) for r in out.collect()} == {
        "a": ("TTTT", 4, True), "b": ("TTTTTTTT", 8, False), "c": ("CC", 2, True)}
    five = reads.trim_adapters(df, five_prime=["TTTTACG"])
    assert {r["read_id"]: r["seq"] for r in five.collect()}["a"] == "TACCGTAGG"
    kept = reads.trim_single_end(df, three_prime=["ACGTACCGTA"], minimum_length=3)
    assert [r["read_id"] for r in kept.collect()] == ["a"]
    paired = reads.trim_paired_end(df, df, (["ACGTACCGTA"], ["ACGTACCGTA"]), minimum_length=3, pair_filter="any", discard_untrimmed=False)
    assert sorted(r["read_id"] for r in paired.collect()) == ["a", "b"]


def test_quality_trim_matches_running_sum(spark):
    rng = random.Random(9)
    quals = ["".join(chr(33 + rng.randint(0, 40)) for _ in range(rng.randint(1, 30))) for _ in range(40)]

    def want(q):
        total = top = cut = 0
        for i, c in enumerate(reversed(q)):
            total += 20 - (ord(c) - 33)
            if total < 0:
                break
            if total > top:
                top, cut = total, i + 1
        return len(q) - cut

    df = spark.createDataFrame([(i, q) for i, q in enumerate(quals)], "i int, qual string")
    got = {r["i"]: r["k"] for r in df.select("i", reads.quality_cut("qual").alias("k")).collect()}
    assert got == {i: want(q) for i, q in enumerate(quals)}


SAM = ["s\tr1:1:1:1:7:100:100\t0\tchr1\t101\t30\t10M\t*\t0\t0\tAAAAAAAAAA\tIIIIIIIIII\tNH:i:1",
       "s\tr1:1:1:1:7:150:120\t0\tchr1\t103\t30\t2S8M\t*\t0\t0\tAAAAAAAAAA\tHHHHHHHHHH\tNH:i:1",
       "s\tr1:1:1:1:9:900:900\t0\tchr1\t101\t30\t10M\t*\t0\t0\tAAAAAAAAAA\tGGGGGGGGGG\tNH:i:2",
       "s\tq2\t16\tchr1\t90\t30\t5M10N12M\t*\t0\t0\tAAAAAAAAAAAAAAAAA\tIIIIIIIIIIIIIIIII\tNH:i:1",
       "s\tq3\t4\t*\t0\t0\t*\t*\t0\t0\tAAA\tIII\tNH:i:1"]


@pytest.fixture(scope="module")
def alignments(spark):
    lines = spark.createDataFrame([tuple(x.split("\t", 1)) for x in SAM], "sample string, value string")
    return sam.parse_sam(lines)


def test_duplicates(alignments):
    marked = {r["qname"]: (r["duplicate"], r["optical"]) for r in reads.find_duplicates(alignments).collect()}
    assert marked["r1:1:1:1:7:100:100"] == (False, False)
    assert marked["r1:1:1:1:7:150:120"] == (True, True)
    assert marked["r1:1:1:1:9:900:900"] == (True, False)
    assert reads.find_duplicates(alignments, "remove_optical").count() == 4
    assert reads.find_duplicates(alignments, "remove_all").count() == 3


def _copies(spark, places):
    """Copies of one fragment at (tile, x, y), the first of the best quality."""
    rows = [("s", f"r:1:1:1:{t}:{x}:{y}:{i}", 0, "chr1", 101, "9M", chr(90 - i % 50) * 9) for i, (t, x, y) in enumerate(places)]
    return spark.createDataFrame(rows, "sample string, qname string, flag int, rname string, pos long, cigar string, qual string")


def test_optical_chain_is_followed(spark):
    """Two steps of 80 pixels reach from the first read to the third; the fourth and fifth are a chain without the kept read."""
    found = {r["qname"][-1]: (r["duplicate"], r["optical"]) for r in reads.find_duplicates(_copies(
        spark, [(1, 0, 0), (1, 80, 0), (1, 160, 0), (1, 900, 900), (1, 820, 820), (2, 0, 0)])).collect()}
    assert found == {"0": (False, False), "1": (True, True), "2": (True, True), "3": (True, False), "4": (True, True), "5": (True, False)}


@pytest.mark.parametrize("distance,field", [(0, 8), (1, 14), (10, 120), (25, 200)])
def test_optical_chains_match_all_pairs(spark, distance, field):
    rng = np.random.default_rng(distance)
    places = [(int(t), int(x), int(y)) for t, x, y in zip(rng.integers(0, 2, 60), rng.integers(-field, field, 60), rng.integers(-field, field, 60))]
    label = list(range(len(places)))
    for a, p in enumerate(places):
        for b, q in enumerate(places[:a]):
            if p[0] == q[0] and max(abs(p[1] - q[1]), abs(p[2] - q[2])) <= distance and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    best = {}
    rows = [(places[i], 9 * (ord(chr(90 - i % 50)) - 33 if 90 - i % 50 - 33 >= 15 else 0), f"r:1:1:1:{places[i][0]}:{places[i][1]}:{places[i][2]}:{i}") for i in range(len(places))]
    for i, (_, score, name) in enumerate(rows):
        best[label[i]] = max(best.get(label[i], (-1, "")), (score, name))
    want = {name: (score, name) != best[label[i]] for i, (_, score, name) in enumerate(rows)}
    got = {r["qname"]: r["optical"] for r in reads.find_duplicates(_copies(spark, places), optical_distance=distance).collect()}
    assert got == want and any(want.values())


def test_blocks_and_feature_counts(spark, alignments):
    b = {r["qname"]: [tuple(x) for x in r["b"]] for r in alignments.select("qname", reads.blocks("pos", "cigar").alias("b")).collect()}
    assert b["q2"] == [(90, 94), (105, 116)]
    features = spark.createDataFrame([("g1", "chr1", 92, 93, "+"), ("g2", "chr1", 100, 104, "+"), ("g3", "chr1", 96, 99, "-")],
                                     "gene string, rname string, start int, end int, strand string")
    counts, stats = reads.count_features(alignments, features, ["s"], bin_size=8)
    assert rows(counts) == {"g1": (1.0,), "g2": (3.0,), "g3": (0.0,)}
    assert rows(stats) == {"Assigned": (4,), "Unassigned_Unmapped": (1,)}
    frac, _ = reads.count_features(alignments, features, ["s"], count_fractionally=True, bin_size=8)
    assert rows(frac)["g2"] == (2.5,)
    none, st = reads.count_features(alignments, features, ["s"], stranded="reverse", count_multi_mapping=False, bin_size=8)
    assert rows(none)["g1"] == (1.0,) and rows(st)["Unassigned_MultiMapping"] == (1,)


def test_reads_of_single_genes_meet_no_feature_pairs(spark, monkeypatch):
    """Genes that lie over each other are told by regions, with exons that touch, repeat and cross bins, on both strands."""
    rng = np.random.default_rng(3)
    feats = [(f"g{int(rng.integers(40))}", f"c{int(rng.integers(2))}", int(s), int(s + rng.integers(0, 30)), "+-"[int(rng.integers(2))]) for s in rng.integers(1, 400, 60)]
    feats += [(f"deep{i}", "c0", 500, 520, "+") for i in range(200)]
    reads_ = [("s", f"q{i}", int(16 * rng.integers(2)), f"c{int(rng.integers(2))}", int(rng.integers(1, 530)), 30, "4M" if i % 3 else "3M20N4M", {"NH": "1"}) for i in range(400)]
    features = spark.createDataFrame(feats, "gene string, rname string, start int, end int, strand string")
    aln = spark.createDataFrame(reads_, "sample string, qname string, flag int, rname string, pos long, mapq int, cigar string, tags map<string,string>")
    monkeypatch.setattr(reads, "overlaps", None)  # the pairs of reads and genes
    for stranded in ("no", "forward", "reverse"):
        for paired in (False, True):
            want, states = {g: 0.0 for g, *_ in feats}, {}
            for _, _, flag, rname, pos, _, cigar, _ in reads_:
                own = [(pos, pos + 3)] if cigar == "4M" else [(pos, pos + 2), (pos + 23, pos + 26)]
                strand = "-" if flag else "+"
                met = {g for g, c, s, e, t in feats if c == rname and any(a <= e and s <= b for a, b in own) and (
                    stranded == "no" or (t == strand) == (stranded == "forward"))}
                state = "Unassigned_NoFeatures" if not met else "Assigned" if len(met) == 1 else "Unassigned_Ambiguity"
                states[state] = states.get(state, 0) + 1
                if len(met) == 1:
                    want[met.pop()] += 1
            counts, stats = reads.count_features(aln, features, ["s"], stranded=stranded, paired=paired, bin_size=16)
            assert {r["gene"]: r["s"] for r in counts.collect()} == want
            assert {r["status"]: r["s"] for r in stats.collect()} == states
    stacked = features.filter("gene like 'deep%'").select(F.xxhash64("gene").bitwiseAND(F.lit(1023)).alias("gene_id"), "rname", "strand", F.col("start").cast("long"), F.col("end").cast("long"))
    assert reads.covered_regions(stacked, 64).count() == 2  # bins 7 and 8


def test_reads_of_many_genes_share_without_pairs(spark, monkeypatch):
    """Shares of overlapping genes: only reads of several segments and genes of several intervals meet one by one."""
    rng = np.random.default_rng(4)
    feats = [(f"g{i}", f"c{int(rng.integers(2))}", int(s), int(s + rng.integers(0, 40)), "+-"[int(rng.integers(2))]) for i, s in enumerate(rng.integers(1, 200, 60))]
    more = [(f"g{i}", "c0", int(s), int(s + 5), "+") for i, s in enumerate(rng.integers(1, 200, 20))]
    reads_ = [("s", f"q{i % 300}", int(16 * rng.integers(2)), f"c{int(rng.integers(2))}", int(rng.integers(1, 220)), 30, "9M", {"NH": str(1 + i % 2)}) for i in range(300)]
    reads_ += reads_[:20]  # repeated rows are one read
    split = [("s", f"p{i}", 0, "c0", int(rng.integers(1, 200)), 30, "3M20N4M", {"NH": "1"}) for i in range(40)]
    fields = "sample string, qname string, flag int, rname string, pos long, mapq int, cigar string, tags map<string,string>"
    formed = []
    pairs = reads.overlaps

    def watched(*args):
        out = pairs(*args)
        formed.append(out.count())
        return out
    monkeypatch.setattr(reads, "overlaps", watched)
    for f, r in ((feats, reads_), (feats + more, reads_ + split)):
        features = spark.createDataFrame(f, "gene string, rname string, start int, end int, strand string")
        for stranded in ("no", "forward", "reverse"):
            want = {g: 0.0 for g, *_ in f}
            for _, _, flag, rname, pos, _, cigar, tags in {x[1]: x for x in r}.values():
                own = [(pos, pos + 8)] if cigar == "9M" else [(pos, pos + 2), (pos + 23, pos + 26)]
                met = {g for g, c, s, e, t in f if c == rname and any(a <= e and s <= b for a, b in own) and (
                    stranded == "no" or (t == ("-" if flag else "+")) == (stranded == "forward"))}
                for g in met:
                    want[g] += 1 / (int(tags["NH"]) * len(met))
            got, _ = reads.count_features(spark.createDataFrame(r, fields), features, ["s"], stranded=stranded, count_multi_overlapping=True, count_fractionally=True, bin_size=16)
            assert {x["gene"]: x["s"] for x in got.collect()} == pytest.approx(want, abs=1e-12)
        if f is feats:
            assert sum(formed) == 0


def test_validation(alignments):
    broken = alignments.withColumn("cigar", F.when(F.col("qname") == "q2", "3M").otherwise(F.col("cigar")))
    assert {(r["rule"], r["count"]) for r in reads.validate_alignments(broken).collect()} == {("MISMATCH_READ_LENGTH_AND_CIGAR", 1)}


def test_salted_join_equals_plain_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("l"))
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("r"))
    heavy = skew.heavy_keys(left, ["k"], share=0.1, floor=100)
    assert [r["k"] for r in heavy.collect()] == [0]
    salted = skew.salted_join(left, right, ["k"], ["l"], 4, heavy)
    assert sorted(map(tuple, salted.select("k", "l", "r").collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    looked = skew.lookup(left, right, ["k"], right.filter("k = 0"), 4)
    assert sorted(map(tuple, looked.collect())) == sorted(map(tuple, left.join(right, "k", "left").select("k", "l", "r").collect()))


# --- clustering ---------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 5]], float)
    data = [(f"g{c}_{i}", [float(v) for v in centres[c] + rng.normal(0, 0.5, 3)]) for c, n in enumerate((40, 30, 20)) for i in range(n)]
    return spark.createDataFrame(data, "gene string, features array<double>").cache()


def groups_of(labels):
    out = {}
    for r in labels.collect():
        out.setdefault(r["cluster"], set()).add(r["gene"].split("_")[0])
    return out


@pytest.mark.parametrize("run", [
    lambda b: cluster.kmeans(b, "gene", 3, seed=1),
    lambda b: cluster.hierarchical(b, "gene", 3),
    lambda b: cluster.hierarchical(b, "gene", distance_threshold=3.0),
    lambda b: cluster.kmedoids(b, "gene", 3, n_init=1),
    lambda b: cluster.density_clusters(b, "gene", 3.0, 5, 10),
])
def test_blobs_are_found_in_size_order(blobs, run):
    assert groups_of(run(blobs)) == {0: {"g0"}, 1: {"g1"}, 2: {"g2"}}


def test_number_of_clusters(blobs):
    for method in cluster.K_CRITERIA:
        scores = {r["k"]: r["score"] for r in cluster.score_k(blobs, "gene", method, 4, n_init=1, seed=1).collect()}
        assert len(scores) == 3 and all(math.isfinite(v) for v in scores.values())
    best = cluster.score_k(blobs, "gene", "calinski_harabasz", 4, seed=1).filter("best").first()["k"]
    assert best == 3


@pytest.mark.parametrize("threshold,chunk", [(0.25, 7), (0.5, 5), (0.75, 2048), (1.0, 3), (1.1, 7)])
def test_feature_consensus_matches_the_coassociation_matrix(spark, threshold, chunk):
    rng = np.random.default_rng(int(threshold * 100))
    table = rng.integers(-1, 6, (90, 4))
    table[60:] = table[rng.integers(0, 60, 30)]
    solutions = spark.createDataFrame([(s, int(c), i) for i, row in enumerate(table) for s, c in enumerate(row) if c >= 0], "solution int, cluster int, gene long")
    together = ((table[:, None] == table[None]) & (table[:, None] >= 0)).sum(2) / 4 >= threshold
    label = list(range(90))
    for a in range(90):
        for b in np.flatnonzero(together[a, :a]):
            if label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    groups = sorted({x for x in label if label.count(x) >= 3}, key=lambda x: (-label.count(x), -x))
    present = [i for i in range(90) if (table[i] >= 0).any()]
    want = {i: groups.index(label[i]) if label[i] in groups else -1 for i in present}
    got = {r["gene"]: r["cluster"] for r in cluster.feature_consensus(solutions, "gene", threshold, 3, chunk_rows=chunk).collect()}
    assert got == want and (max(want.values()) >= 0) == (threshold <= 1)


def test_consensus_of_repeated_solutions(spark, blobs):
    labels = blobs.select("gene", F.substring("gene", 2, 1).cast("int").alias("cluster"))
    solutions = labels.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("solution"), "cluster", "gene")
    assert groups_of(cluster.consensus(solutions, "gene", 0.6, min_cluster_size=5)) == {0: {"g0"}, 1: {"g1"}, 2: {"g2"}}
    assert groups_of(cluster.consensus(solutions, "gene", 0.6, min_cluster_size=5, by="feature")) == {0: {"g0"}, 1: {"g1"}, 2: {"g2"}}
    sim = {(r["a"], r["b"]): r["similarity"] for r in cluster.cluster_similarity(solutions, "gene").collect()}
    assert sim["0:0", "1:0"] == pytest.approx(1.0) and ("0:0", "0:1") not in sim


def test_components(spark):
    nodes = spark.range(12).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 7)] + [(9, 11)], "a long, b long")
    got = {r["node"]: r["component"] for r in graphs.connected_components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(8)}, 8: 8, 9: 9, 10: 10, 11: 9}


def test_distance_metrics():
    x = np.array([[1.0, 2, 3, 4], [4, 3, 2, 1], [1, 2, 3, 5]])
    for metric in distance.METRICS:
        d = distance.distances(x, x, metric)
        assert d.shape == (3, 3) and np.allclose(d, d.T, atol=1e-12)
        if metric != "sharpened_cosine":
            assert np.allclose(np.diag(d), 0, atol=1e-9)
    assert distance.distances(x, x, "spearman")[0, 1] == pytest.approx(1) and distance.distances(x, x, "spearman")[0, 2] == pytest.approx(0)


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(4)
    m = rng.gamma(2, 20, (60, 5))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "gene int, " + ", ".join(f"s{i} double" for i in range(5)))
    names = [f"s{i}" for i in range(5)]
    fit = pca.PCA(df, "gene", names, False)
    z = (m - m.mean(1, keepdims=True)) / m.std(1, keepdims=True)
    u, s, vt = np.linalg.svd(z.T, full_matrices=False)
    got = np.array([r[1:] for r in fit.scores(2).collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    load = np.array([r[1] for r in sorted(fit.loadings([1]).collect())])
    assert np.allclose(np.abs(load), np.abs(vt[0]), atol=1e-8)
    assert fit.explained().agg(F.max("cumulative")).first()[0] == pytest.approx(100)
    assert np.allclose(pca.gram_matrix(fit.rows, 5), z.T @ z)  # one product per batch for any number of samples


def test_row_box_cox_maximises_likelihood():
    x = np.random.default_rng(1).gamma(2, 30, (5, 9))
    y = pca.row_box_cox(x)
    for row, out in zip(x + 1, y):
        lam = np.linspace(-5, 5, 20001)
        lam = lam[np.abs(lam) > 1e-9]
        ll = [(v - 1) * np.log(row).sum() - len(row) / 2 * np.log(((row ** v - 1) / v).var()) for v in lam]
        best = lam[int(np.argmax(ll))]
        assert np.allclose(out, (row ** best - 1) / best, rtol=1e-2)


# --- designs and models ---------------------------------------------------------------------------------------------------------

DESIGN = pd.DataFrame({"sample": ["c1", "c2", "c3", "t1", "t2", "t3"], "condition": ["ctl"] * 3 + ["trt"] * 3,
                       "batch": ["x", "y", "z"] * 2, "age": [1, 2, 4, 3, 5, 9]})
SIX = list(DESIGN["sample"])


def test_design_checks_and_terms():
    d = designs.check_design(DESIGN.iloc[::-1], SIX)
    assert list(d.index) == SIX
    x, names = designs.model_matrix(d, ["condition", "age", "condition:age", "poly(age, degree=2)"][:3])
    assert names == ["Intercept", "conditiontrt", "age", "conditiontrt:age"] and x.shape == (6, 4)
    assert designs.model_matrix(d, ["poly(age, degree=2)"])[1] == ["Intercept", "poly(age, 2)1", "poly(age, 2)2"]
    assert list(designs.contrast(d, names, "condition", "trt", "ctl")) == [0, 1, 0, 0]
    assert designs.reduced_model(["condition", "age", "condition:age"], "age") == ["condition"]
    with pytest.raises(ValueError):
        designs.check_design(DESIGN, SIX[:-1])
    with pytest.raises(ValueError):
        designs.check_design(DESIGN.rename(columns={"batch": "1bad name"}), SIX)


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(7)
    data = []
    for g in range(300):
        mu = rng.gamma(2, 100) + 20
        fold = 6.0 if g < 10 else 1 / 6 if g < 20 else 1.0  # balanced, so that library sizes stay comparable
        for_group = [mu] * 3 + [mu * fold] * 3
        data.append((f"g{g:03d}", *[float(rng.negative_binomial(20, 20 / (20 + m))) for m in for_group]))
    return spark.createDataFrame(data, "gene string, " + ", ".join(f"{s} double" for s in SIX)).cache()


@pytest.mark.parametrize("run,column", [(models.limma_voom, "logFC"), (models.deseq2, "log2FoldChange")])
def test_planted_genes_are_found(simulated, run, column):
    res = run(simulated, "gene", SIX, DESIGN, [("condition", "trt", "ctl")], lrt_factors=["condition"], model_factors=["condition"])
    table = res["condition_trt_vs_ctl"].toPandas()
    hits = set(table[table["padj"] < 0.05]["gene"])
    planted = {f"g{g:03d}" for g in range(20)}
    assert planted <= hits and len(hits - planted) <= 12
    assert table[table["gene"] < "g010"][column].mean() == pytest.approx(math.log2(6), abs=0.4)
    assert table[(table["gene"] >= "g010") & (table["gene"] < "g020")][column].mean() == pytest.approx(-math.log2(6), abs=0.4)
    lrt = res["LRT_condition"].toPandas()
    assert planted <= set(lrt[lrt["padj"] < 0.05]["gene"])


@pytest.mark.parametrize("adapter,least", [("ACGTACC", 3), ("ACNTNC", 2), ("AAAA", 1), ("ACGTA", 6)])
def test_adapters_without_errors_need_no_alignment(adapter, least, monkeypatch):
    rng = np.random.default_rng(5)
    reads = ["", "A", adapter.lower(), "ACGTACCACGTACC", "\nACGTACé"] + ["".join(rng.choice(list("ACGTacgtN"), n)) for n in rng.integers(0, 40, 300)]
    reads += [r + adapter[:i] for i in range(len(adapter)) for r in reads[5:60]]
    aligned = [adapters._search_block([r], np.array([True]), adapter, 0.1, least, True) for r in reads]
    monkeypatch.setattr(adapters, "_search_block", None)
    got = adapters.search_three_prime(reads, adapter, 0.1, least)
    for one, want in zip(got, zip(*aligned)):
        assert one.tolist() == [int(x[0]) for x in want]


def test_reads_of_one_place_are_one_kind(spark):
    """Reads with the same segments and judgement meet features once, with their number."""
    rows = spark.createDataFrame([(f"r{i}", "A", "c", "+", None if i % 5 else "low", 1 + i % 2, [(10, 30)]) for i in range(600)] + [("s", "A", "c", "+", None, 1, [(10, 12), (28, 30)])],
                                 "read string, sample string, rname string, strand string, reason string, nh int, blocks array<struct<start:long,end:long>>")
    features = spark.createDataFrame([("g", "c", 25, 40, "+"), ("h", "c", 1, 15, "+"), ("k", "c", 18, 20, "+")], "gene string, rname string, start long, end long, strand string")
    heavy = spark.createDataFrame([], "rname string, bin long, strand string")
    judged, shares = reads._all_genes(rows, features, 16, heavy, "no", 1 / (F.col("nh") * F.col("genes")))
    kinds = judged.collect()
    assert len(kinds) <= 5 and sum(r["n"] for r in kinds) == 601
    assert sorted((r["nh"], r["n"], r["genes"]) for r in kinds if r["ok"]) == [(1, 1, 2), (1, 240, 3), (2, 240, 3)]
    sums = {r["gene"]: float(r["w"]) for r in shares.groupBy("gene").agg(F.sum("w").alias("w")).collect()}
    assert sums == {"g": pytest.approx(120.5), "h": pytest.approx(120.5), "k": pytest.approx(120.0)}


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_duplicates_are_told_without_moving_the_table(spark):
    """Few places and few chains travel to the rows; mates meet in one exchange, and pairs are judged as one."""
    assert _exchanges(reads.find_duplicates(_copies(spark, [(1, 5 * i, 0) for i in range(40)]))) == 0
    rng = np.random.default_rng(6)
    rows, judged = [], {}
    for i in range(60):
        at, name, quality = int(rng.integers(100, 103)), f"q{i:02d}", [int(x) for x in rng.integers(50, 70, 2)]
        mates = 2 if i % 6 else 1
        for mate in range(mates):
            rows.append(("s", name, 1 | (64, 128 | 16)[mate], "c", at + 20 * mate, "5M", chr(quality[mate]) * 5))
        best = sum(5 * (q - 33) for q in quality[:mates])
        judged[name] = ((at, mates), (best, name))
    kept = {}
    for place, mine in judged.values():
        kept[place] = max(kept.get(place, mine), mine)
    marked = reads.find_duplicates(spark.createDataFrame(rows, "sample string, qname string, flag int, rname string, pos long, cigar string, qual string"))
    assert _exchanges(marked) == 1
    got = marked.collect()
    assert len(got) == len(rows) and {(r["qname"], r["duplicate"]) for r in got} == {(n, mine != kept[place]) for n, (place, mine) in judged.items()}
