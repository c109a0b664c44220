import pytest
from pyspark.sql import functions as F

from keyloom.operators import aggregates, filters, ranking, sets, sorting
from keyloom.table import CountTable, DETable
from conftest import SAMPLES, rows


def ids(df, key="gene"):
    return sorted(r[key] for r in df.select(key).collect())


def test_complement_is_by_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("b", 1), (None, 1), ("c", None)], "gene string, x int")
    assert ids(filters.number_filters(df, "gene", "x", ">", 5)) == ["a"]
    assert ids(filters.number_filters(df, "gene", "x", ">", 5, opposite=True)) == ["b", "c"]


def test_text_and_missing(spark):
    df = spark.createDataFrame([("a", "x.y"), ("b", "xzy"), ("c", None)], "gene string, t string")
    assert ids(filters.text_filters(df, "gene", "t", "contains", "x.y")) == ["a", "b"]
    assert ids(filters.text_filters(df, "gene", "t", "in", "x.y", literal=True)) == ["a"]
    assert ids(filters.filter_missing_values(df, "gene", opposite=True)) == ["c"]
    nan = spark.createDataFrame([("a", float("nan")), ("b", None)], "gene string, v double")
    assert ids(filters.filter_missing_values(nan, "gene")) == ["a"]
    with pytest.raises(KeyError):
        filters.filter_missing_values(df, "gene", "nope")
    with pytest.raises(ValueError):
        filters.number_filters(nan, "gene", "v", "between", 1)


def test_duplicates_by_row_order(spark):
    df = spark.createDataFrame([("a", 2, 20), ("a", 1, 10), ("b", 3, 30)], "gene string, o int, v int")
    assert rows(filters.filter_duplicate_ids(df, "gene", ["o"], "first")) == {"a": (1, 10), "b": (3, 30)}
    assert rows(filters.filter_duplicate_ids(df, "gene", ["o"], "last")) == {"a": (2, 20), "b": (3, 30)}
    assert rows(filters.filter_duplicate_ids(df, "gene", ["o"], "neither")) == {"b": (3, 30)}


def test_quantiles_match_brute_force(spark):
    values = [5.0, 1.0, 1.0, 1.0, 9.0, 7.0, 2.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 4.0), ("g", None)], "g string, v double")
    ordered = sorted(values)
    for q in (0.0, 0.1, 0.37, 0.5, 0.99, 1.0):
        h = (len(values) - 1) * q
        lo, hi = ordered[int(h)], ordered[min(int(h) + (h > int(h)), len(values) - 1)]
        want = {"lower": lo, "higher": hi, "midpoint": (lo + hi) / 2, "linear": lo + (hi - lo) * (h - int(h)),
                "nearest": ordered[int(h + 0.5)]}
        for kind, w in want.items():
            got = rows(ranking.quantiles(df, "v", {"q": q}, ["g"], kind))
            assert got["g"][0] == pytest.approx(w) and got["h"][0] == 4.0


def test_row_numbers_and_average_ranks(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id"), (F.col("id") % 7).alias("v"))
    numbered = ranking.row_numbers(df, ["g"], ["v", "id"], "n").collect()
    for g in (0, 1):
        part = sorted((r for r in numbered if r["g"] == g), key=lambda r: r["n"])
        assert [r["n"] for r in part] == list(range(1, 501))
        assert [(r["v"], r["id"]) for r in part] == sorted((r["v"], r["id"]) for r in part)
    ranked = ranking.average_ranks(df, "v", ["g"]).filter("g = 0").collect()
    vs = sorted(r["v"] for r in ranked)
    for r in ranked:
        spots = [i + 1 for i, v in enumerate(vs) if v == r["v"]]
        assert r["rank"] == sum(spots) / len(spots)


def test_fdr_against_definition(spark):
    ps = [0.01, 0.02, 0.02, 0.8, 0.04, None, 0.5]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, pval double")
    got = {r["i"]: r["padj"] for r in ranking.fdr_adjust(df).collect()}
    known = [p for p in ps if p is not None]
    m = len(known)
    for i, p in enumerate(ps):
        want = None if p is None else min(1.0, min(q * m / sum(k <= q for k in known) for q in known if q >= p))
        assert got[i] == (None if want is None else pytest.approx(want))
    by = {r["i"]: r["padj"] for r in ranking.fdr_adjust(df, method="by").collect()}
    assert by[0] == pytest.approx(min(1.0, got[0] * sum(1 / i for i in range(1, m + 1))))


def test_set_algebra(spark):
    def s(*xs):
        return spark.createDataFrame([(x,) for x in xs], "gene string")
    a, b, c = s("1", "2", "3"), s("2", "3", "4"), s("3", "5")
    assert ids(sets.union([a, b, c], "gene")) == ["1", "2", "3", "4", "5"]
    assert ids(sets.intersection([a, b, c], "gene")) == ["3"]
    assert ids(sets.difference(a, [b, c], "gene")) == ["1"]
    assert ids(sets.symmetric_difference([a, b], "gene")) == ["1", "4"]
    assert ids(sets.majority_vote_intersection([a, b, c], "gene", 2 / 3)) == ["2", "3"]
    assert ids(sets.intersection_nonempty([a, s("9").limit(0), b], "gene")) == ["2", "3"]
    with pytest.raises(TypeError):
        sets.symmetric_difference([a, b, c], "gene")
    with pytest.raises(ValueError):
        sets.venn({"a": a}, "gene")
    sizes = {r["sets"]: r["size"] for r in sets.exclusive_intersections({"a": a, "b": b, "c": c}, "gene").collect()}
    assert sizes == {"a": 1, "b": 1, "c": 1, "a;b": 1, "a;c": 0, "b;c": 0, "a;b;c": 1}
    with pytest.raises(ValueError):
        sets.concatenate(a, b, "gene")


def test_sorting_and_nulls(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", None), ("c", 1.0)], "gene string, v double")
    assert [r["gene"] for r in sorting.sort(df, "v").collect()] == ["c", "a", "b"]
    assert [r["gene"] for r in sorting.sort(df, "v", False, "first").collect()] == ["b", "a", "c"]
    assert ids(sorting.filter_top_n(df, "gene", "v", 2)) == ["a", "c"]
    assert ids(sorting.filter_top_n(df, "gene", "v", 2, opposite=True)) == ["b"]


def test_count_table_methods(counts):
    t = CountTable(counts, "gene")
    assert t.samples == SAMPLES and t.shape() == (22, 4) and t.contains("WBGene00007063") and t.has_unique_keys()
    high, low = t.split_by_reads(60)
    assert high.df.count() + low.df.count() == 22
    assert t.filter_low_reads(5, 4).df.count() == sum(all(v >= 5 for v in r[1:]) for r in counts.collect())
    assert t.filter_by_row_sum(5).df.count() == sum(sum(r[1:]) >= 5 for r in counts.collect())
    fc = t.fold_change(["cond1", "cond2"], ["cond3", "cond4"])
    assert rows(fc.df)["WBGene00007063"][0] == pytest.approx((542 + 1) / (376.5 + 1))
    table, factors = t.normalize_to_rpm(return_scaling_factors=True)
    assert factors.count() == 4
    assert t.equals(CountTable(counts.orderBy("cond1"), "gene"))


def test_de_table_roles(spark):
    df = spark.createDataFrame([("a", 2.0, 0.01), ("b", -3.0, 0.5), ("c", 0.0, None)], "gene string, lfc double, q double")
    t = DETable(df, "gene", log2fc="lfc", padj="q")
    assert ids(t.filter_significant(0.05).df) == ["a"]
    assert ids(t.filter_significant(0.05, opposite=True).df) == ["b", "c"]
    pos, neg = t.split_fold_change_direction()
    assert ids(pos.df) == ["a"] and ids(neg.df) == ["b"]
    with pytest.raises(KeyError):
        DETable(df, "gene").filter_significant()


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    h = sorted(aggregates.histogram(df, "x", 5).collect())
    assert [r["count"] for r in h] == [2, 2, 2, 2, 3]


def test_identifier_patterns(spark):
    from keyloom.functions import scalar
    df = spark.createDataFrame([("see WBGene00000001, lin-4 and AH6.1 or Y55D5A.5 P12345 GO:0008150",), ("daf-2.1 WBGene00000001",)], "t string")

    def found(pattern):
        return sorted(r["id"] for r in scalar.extract_ids(df, "t", pattern).collect())
    assert found(scalar.WBGENE_PATTERN) == ["WBGene00000001"]
    assert found(scalar.GENE_NAME_PATTERN) == ["daf-2.1", "lin-4"]
    assert found(scalar.SEQUENCE_NAME_PATTERN) == ["Y55D5A.5"]
    first = df.select(scalar.first_id("t", scalar.UNIPROT_PATTERN).alias("u"), scalar.first_id("t", scalar.GO_PATTERN).alias("g")).collect()
    assert [tuple(r) for r in first] == [("P12345", "GO:0008150"), (None, None)]
    names = spark.createDataFrame([("1 a-b ",), ("x/y.fastq.gz",)], "t string")
    got = [tuple(r) for r in names.select(scalar.sanitize_name("t"), scalar.strip_suffixes("t"), scalar.remove_given_suffix("t", [".gz", ".fastq.gz"])).collect()]
    assert got[0][0] == "var_1_a_b" and got[1] == ("x_y_fastq_gz", "x/y", "x/y")
