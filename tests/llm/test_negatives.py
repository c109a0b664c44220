"""Hard negatives against brute force."""

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every=3, positives=5, per=3, low=50, high=95):
    sound = []
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        sound.append((vec_id, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for vec_id, label, v in sound:
        if vec_id % every:
            continue
        scored = sorted([(-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in sound if i != vec_id and len(w) == len(v)])
        scored += [(-sum(x * y for x, y in zip(v, w)), i, False) for i, other, w in sound if i == vec_id and other != label and len(w) == len(v)]
        scored.sort()
        for s, i, same in [x for x in scored if x[2]][:positives]:
            fit = [(n, t) for t, n, own in scored if not own and low * -s <= 100 * -t <= high * -s][:per]
            out += [(vec_id, i, rank, n, -s, -t) for rank, (n, t) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=3, **more):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, **more).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def random_rows(n, dim, seed=0, labels=4, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    v = middle[rng.integers(0, centres, n)] + 0.4 * rng.normal(size=(n, dim))
    return [(i, int(rng.integers(0, labels)), [float(x) for x in row / (np.linalg.norm(row) if dim > 1 else 1)]) for i, row in enumerate(v)]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "PACK_ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 16)
    for dim, seed in ((24, 1), (7, 2), (1, 3)):
        rows = random_rows(300, dim, seed)
        got = mined(spark, rows)
        assert got == brute(rows) and got


def test_ties_and_repeated_vectors(spark):
    rows = [(i, i % 2, [0.5, 0.25, 0.25, 0.5]) for i in range(30)] + [(i, i % 2, [0.4, 0.3, 0.3, 0.4]) for i in range(30, 60)] + [(60, 0, [1.0, 1.0, 1.0, 1.0])]
    assert mined(spark, rows) == brute(rows) and brute(rows)
    rows += [rows[3], rows[60], (6, 1, [0.1, 0.9, 0.1, 0.2])]  # repeated rows, and an id with two labels
    assert mined(spark, rows) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = random_rows(80, 8, 5)
    odd = [(None, 1, [0.1] * 8), (81, None, [0.1] * 8), (84, 1, None), (87, 1, [0.1] * 7 + [None]), (90, 1, [float("nan")] * 8), (93, 1, [float("inf")] * 8),
           (96, 1, []), (99, 1, []), (100, 2, []), (102, 1, [0.1] * 3), (105, 1, [0.1] * 3), (103, 2, [0.08] * 3), (108, 1, [0.0] * 8), (111, 1, [-0.1] * 8)]
    got = mined(spark, rows + odd)
    assert got == brute(rows + odd)
    assert mined(spark, [*rows, (114, 1, [1e30] * 8), (115, 2, [3e9] * 8)]) == mined(spark, rows)  # scores would not fit a long
    assert mined(spark, spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark, [(0, 1, [0.5])]) == [] and mined(spark, [(0, 1, [0.5]), (1, 1, [0.5])]) == []


def test_scores_beyond_exact_doubles(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [float(np.float32(x)) for x in rng.normal(size=5) * 1e6]) for i in range(60)]
    assert mined(spark, rows) == brute(rows) and brute(rows)


def test_other_columns_and_parameters(spark):
    rows = random_rows(90, 8, 6)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS vector", "1 AS anchor", "2 AS part", "3 AS rank", "4 AS pack")
    assert mined(spark, df, positives=2, negatives=7, low=10, high=80) == brute(rows, positives=2, per=7, low=10, high=80)


def test_bounds_hold_and_leave_pairs_out():
    rng = np.random.default_rng(8)
    smooth = np.cumsum(rng.normal(size=(200, 64)), axis=1)  # neighbouring components are alike: segments say much
    packs = [negatives.Pack(np.arange(100).tobytes(), np.zeros(100, np.int64).tobytes(), np.floor(16 * v).tobytes(), 64) for v in (smooth[:100], smooth[100:])]
    true = packs[0].vectors @ packs[1].vectors.T
    for (m, s), (m2, s2) in zip(packs[0].levels, packs[1].levels):
        assert (np.abs(true - m @ m2.T) <= s @ s2.T + 1e-6).all()
    tally, floor = [0, 0], np.quantile(true, 0.98, axis=1)
    a, b, found, mask = negatives.scores(*packs, np.ones((100, 100), bool), floor, np.full(100, np.inf), tally)
    want = {(i, j) for i, j in zip(*np.nonzero(true >= floor[:, None]))}
    got = {(a[i], b[j]) for i, j in zip(*np.nonzero(mask)) if found[i, j] >= floor[a[i]]}
    assert got == want and all(found[i, j] == true[a[i], b[j]] for i, j in zip(*np.nonzero(mask)))
    assert tally[1] < 0.1 * tally[0]
