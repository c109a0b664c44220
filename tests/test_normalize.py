import pytest

from keyloom.functions import scalar
from keyloom.operators import normalize
from conftest import SAMPLES, rows

# expected rows of the 22-gene count matrix
EXPECTED = {
    "rpm": {"WBGene00007063": (11437.76087, 9279.262597, 3921.990007, 5689.483254),
            "WBGene00043988": (271958.5133, 259140.3823, 236684.038, 229324.3005)},
    "quantile75": {"WBGene00007063": (976.1261528, 733.7044376, 236.4039963, 325.2680879),
                   "WBGene00007064": (92.52380595, 92.72982914, 12.95364364, 19.28135572)},
    "quantile32": {"WBGene00007063": (399.2318376, 347.875, 521.3024194, 928.5783784),
                   "WBGene00007075": (9495.789174, 9831.518293, 30972.50484, 37023.47297)},
    "tmm": {"WBGene00007063": (584.0707991988443, 400.7530424099043, 400.9653116966796, 430.78018377056236),
            "WBGene00007075": (13892.211615699525, 11325.938533385013, 23822.832190285462, 17175.694440542782)},
    "rle": {"WBGene00007063": (618.6048896, 448.4109512, 296.1686774, 448.4109512),
            "WBGene00043988": (14708.72385, 12522.69608, 17873.17111, 18073.96615)},
    "mrn": {"WBGene00007063": (500.7720475, 406.2679209, 370.1203339, 536.9196346),
            "WBGene00043988": (11906.98276, 11345.77487, 22336.00163, 21641.45919)},
}


@pytest.mark.parametrize("name,fn", [
    ("rpm", lambda df: normalize.normalize_to_rpm(df, "gene")),
    ("quantile75", lambda df: normalize.normalize_to_quantile(df, "gene", 0.75)),
    ("quantile32", lambda df: normalize.normalize_to_quantile(df, "gene", 0.32)),
    ("tmm", lambda df: normalize.normalize_tmm(df, "gene", ref="cond1")),
    ("rle", lambda df: normalize.normalize_rle(df, "gene")),
    ("mrn", lambda df: normalize.normalize_median_of_ratios(df, [["cond1", "cond2"], ["cond3", "cond4"]])),
])
def test_golden_values(counts, name, fn):
    got = rows(fn(counts))
    for gene, want in EXPECTED[name].items():
        assert got[gene] == pytest.approx(want, rel=1e-7)


def test_box_cox_golden(counts):
    got = rows(scalar.box_cox(counts.select("gene", "cond1", "cond4"), ["cond1", "cond4"]))
    assert got["WBGene00007063"] == pytest.approx((0.6832713352586444, 0.7348330561761056), abs=1e-6)
    assert got["WBGene00044951"] == pytest.approx((-1.4127337648436191, -0.8870766826460401), abs=1e-6)


def test_factors_multiply_to_one(counts):
    f = normalize.tmm_factors(counts, "gene", SAMPLES)
    product = 1.0
    for v in f.values():
        product *= v
    assert product == pytest.approx(1.0)


def test_keyed_and_one_row_factors(counts, spark):
    one = spark.createDataFrame([(2.0, 4.0, 5.0, 10.0)], ", ".join(f"{s} double" for s in SAMPLES))
    assert rows(normalize.normalize_with_scaling_factors(counts, "gene", one))["WBGene00007063"] == (316.5, 112.75, 73.0, 38.8)
    keyed = counts.select("gene", *[(counts[s] + 1).alias(s) for s in SAMPLES])
    assert rows(normalize.normalize_with_scaling_factors(counts, "gene", keyed))["WBGene00077502"] == (0.0,) * 4


def test_rle_needs_a_complete_row(spark):
    df = spark.createDataFrame([("a", 0, 1), ("b", 2, 0)], "gene string, x long, y long")
    with pytest.raises(ValueError):
        normalize.normalize_rle(df, "gene")
