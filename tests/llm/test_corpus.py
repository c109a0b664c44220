"""Nearest neighbours, packing, mixing, training order and the pipeline."""

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import ann, mixing, ordering, packing, queries, simhash
from keyloom.llm.common import running_sum, store

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>"


def brute_nearest(rows, asked, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, v in good:
        if q in asked:
            scored = sorted(((-float((v * w).sum()), i) for i, w in good if i != q))[:k]
            out |= {(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(scored)}
    return out


def found(df):
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect()}


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(40)]
    rows += [(100, None), (101, [0.0] * 6), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [math.nan] * 6), (104, [math.inf] * 6), (None, [1.0] * 6)]
    rows += [(200 + i, rows[3][1]) for i in range(9)]  # equal vectors: ties by id
    table = spark.createDataFrame(rows, VECTORS).withColumns({"v": F.lit(1), "tree": F.lit(2), "uid": F.lit(3), "query": F.lit(4)})
    asked = {0, 3, 20, 100, 101, 203, 204}
    assert found(ann.nearest(table, table.filter(F.col("vec_id").isin(*asked)), 5)) == brute_nearest(rows, asked, 5)
    assert found(ann.nearest(table.filter("vec_id < 3"), table.filter("vec_id < 3"), 5)) == brute_nearest(rows[:3], {0, 1, 2}, 5)
    assert ann.nearest(table.filter("false"), table, 5).collect() == [] == ann.nearest(table, table.filter("false"), 5).collect()


@pytest.mark.parametrize("leaf", [4096, 8])
def test_vectors_meet_those_of_their_length(spark, leaf):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5 if i % 3 else 8)]) for i in range(60)] + [(100, [9.0] * 30), (4, [1.0] * 5), (4, [1.0] * 5)]
    table = spark.createDataFrame(rows, VECTORS)
    got = ann.nearest(table, table.filter("vec_id IN (0, 1, 100)"), 70, leaf=leaf).collect()  # more than there are: all trees ascend to the root
    assert Counter((r["query_id"], r["vec_id"]) for r in got) == Counter(
        (q, i) for q, size in ((0, 8), (1, 5)) for i, v in rows if len(v) == size and i != q)
    equal = spark.createDataFrame([(300, [3.0] * 5)] * 6 + [(301, [3.0] * 5), (302, [3.0] * 5)] + rows[:9], VECTORS)
    got_equal = ann.nearest(equal, equal.filter("vec_id = 301"), 4, leaf=leaf).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got_equal, key=lambda r: r["rank"])] == [(1, 300), (2, 300), (3, 300), (4, 300)]
    got_equal = ann.nearest(equal, equal.filter("vec_id = 300").limit(1), 2, leaf=leaf).collect()
    assert {(r["rank"], r["vec_id"]) for r in got_equal} == {(1, 301), (2, 302)}
    dim = dict((i, v) for i, v in rows[:60])
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == sorted(
        (i for i in dim if i and i % 3 == 0), key=lambda i: -float(np.float32(dim[0]).astype(float) @ np.float32(dim[i]).astype(float)))


@pytest.mark.parametrize("scaled", [False, True])
def test_forest_reaches_the_recall(spark, scaled):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    points = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    points /= np.linalg.norm(points, axis=1)[:, None]
    points *= rng.uniform(0.5, 2, 3000)[:, None] if scaled else 1
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, VECTORS)
    got = found(ann.nearest(table, table.filter("vec_id % 50 = 0"), 10, leaf=128))
    want = brute_nearest(rows, set(range(0, 3000, 50)), 10)
    assert Counter(q for q, *_ in got) == Counter(q for q, *_ in want)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


def test_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    got = found(queries.op4_nearest_neighbours(spark, "/root/testdata/sf0.1"))
    want = brute_nearest(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


def test_longer_strings_catch_less():
    levels = np.arange(1, 9)
    chance = ann.recall_at(levels, np.full(8, 0.5), 4)
    assert (np.diff(chance) < 0).all() and ann.recall_at(np.array([0]), np.array([0.1]), 1)[0] == 1


def check_bins(pieces, sizes, capacity):
    held = defaultdict(list)
    for p in pieces:
        held[p["bin_id"]].append(p)
    for own in held.values():
        own.sort(key=lambda p: (p["offset"], p["size"]))
        assert sum(p["size"] for p in own) <= capacity
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["size"]
        assert len({p["source"] for p in own}) == len(own)
        assert len({p["cluster"] for p in own}) == len(own)
    whole = defaultdict(list)
    for p in pieces:
        whole[p["uid"]].append((p["first_word"], p["size"], p["doc_id"]))
    assert sorted(((w[0][2], sum(s for _, s, _ in w)) for w in whole.values()), key=repr) == sorted(sizes, key=repr)
    for w in whole.values():
        w.sort()
        assert [f for f, _, _ in w] == list(np.cumsum([0, *[s for _, s, _ in w][:-1]]))


def test_packing_keeps_all_words_and_all_conflicts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 90)) + [str(i % 40)]), f"s{rng.integers(6)}") for i in range(300)]
    rows += [(1000, "long " * 1234, "s0"), (1001, None, "s1"), (1002, "", None), (1003, " \n", None), (None, "a b", "s0"), (5, "a b", "s0"), (5, "a b", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"uid": F.lit("x"), "size": F.lit("y"), "shard": F.lit(0)})
    for shard_docs in (64, 100_000):
        pieces = packing.pack(docs, 100, shard_docs).collect()
        check_bins(pieces, [(i, len((t or "").split())) for i, t, _ in rows], 100)
    assert packing.pack(docs.filter("false")).collect() == []


def test_bins_do_not_depend_on_splits(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i) if i % 17 else None, " ".join(["w"] * int(rng.integers(0, 60)) + [str(i % 300)]), f"s{i % 9}") for i in range(2000)]
    rows += [(7, "same text", "s1")] * 50 + [(None, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = [sorted(packing.pack(docs.repartition(n), 100, 250).collect(), key=repr) for n in (1, 7)]
    assert made[0] == made[1] and len({r["uid"] for r in made[0]}) == len(rows) == len(made[0])


def brute_best_fit(items, capacity):
    """items: (size, source, cluster) in order; every open bin is looked at."""
    bins, placed = [], []
    for size, source, cluster in items:
        fits = [(b["left"], n) for n, b in enumerate(bins) if b["left"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
        if not fits:
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        left = min(fits)[0] if fits else capacity
        n = min(fits)[1] if fits else len(bins) - 1
        b = bins[n]
        b["left"] -= size
        b["sources"].add(source), b["clusters"].add(cluster)
        placed.append(left - size)
    return placed, len(bins)


def test_successor_search_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(3)
    for _ in range(30):  # one cluster per item: which of equally tight bins is taken may differ only by conflicts, so give them few
        items = [(int(s), int(c), 100 + i) for i, (s, c) in enumerate(zip(rng.integers(1, 60, 40), rng.integers(0, 40, 40)))]
        bins, left = packing.Bins(64), []
        for size, source, cluster in items:
            before = sorted(r for r, level in bins.at.items() for sources, own in level.items() for _, clusters in own
                            if r >= size and not sources & 1 << source and not clusters & 1 << cluster)
            _, offset = bins.place(size, 1 << source, 1 << cluster)
            assert 64 - offset == (before[0] if before else 64)
            left.append(64 - offset - size)
        assert brute_best_fit(items[:6], 64)[0] == left[:6]


def test_mixing_meets_targets_and_agrees_on_reruns(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), f"s{min(int(rng.exponential(2)), 7)}") for i in range(800)]
    rows += [(900, None, None), (901, "a b c", None), (None, "x y", "s0"), (902, "", "empty"), (7, "tie", "s1"), (7, "tie", "s1"), (903, "big " * 5000, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "copies": F.lit(0), "target": F.lit(1)})
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and sorted((r["doc_id"], r["taken"]) for r in got if r["doc_id"]) == sorted(
        (r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs.repartition(5)).collect() if r["doc_id"])
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    targets, total = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values())
    open_ = set(names)
    while True:  # share what is left by weight among the sources that are not full, until nobody overflows
        left = total - sum(targets[s] for s in names if s not in open_)
        shares = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if shares[s] > 2 * sizes[s]}
        if not over:
            targets |= shares
            break
        targets |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]], abs_tol=1e-6)
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in names)
    assert mixing.mix_sources(docs.filter("false")).collect() == []


def test_pareto_sampling_favours_no_document(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("s").alias("source"))
    counts = Counter(r["doc_id"] for seed in range(12) for r in mixing.mix_sources(docs, (1,), 0.25, seed=str(seed)).collect() if r["copies"])
    assert sum(counts.values()) == 12 * 100 and len(counts) > 350


def test_permutation_is_a_bijection_that_the_key_selects():
    for total in (1, 2, 3, 5, 64, 1000, 4097):
        slots = ordering.permute(np.arange(total), total, 42)
        assert sorted(slots.tolist()) == list(range(total))
    a, b = ordering.permute(np.arange(5000), 5000, 1), ordering.permute(np.arange(5000), 5000, 2)
    assert (a != b).mean() > 0.99 and abs(np.corrcoef(np.arange(5000), a)[0, 1]) < 0.05


def test_long_white_space_has_the_ids_of_the_pattern():
    enc = ordering.encoding(ordering.TOKENIZER)
    rng = np.random.default_rng(5)
    signs = [" ", "\n", "\u3000", "\x85", "\x1c", "ab", "1", "!", "'s", "\u00e9"]
    for _ in range(200):
        text = "".join(signs[rng.integers(len(signs))] * int(rng.choice([1, 2, 999, 1000, 1001])) for _ in range(rng.integers(1, 7)))
        assert ordering.token_ids(enc, text) == enc.encode_ordinary(text)
    assert ordering.token_ids(enc, "") == []
    text = "a" + " " * 5_000_000 + "b" + "\n" * 5_000_000
    assert enc.decode(ordering.token_ids(enc, text)) == text
    assert len(ordering.token_ids(enc, "a" * 5_000_000)) == 1_250_000


def test_training_order_round_trip(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "long é€ text\n" * 400), (None, "no id"), (5, "same"), (5, "same"), (6, "<|endoftext|>")]
    rows += [(100 + i, f"document number {i} " * (i % 7)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"number": F.lit(1), "record": F.lit("r"), "part": F.lit(2)})
    shards = store(ordering.training_order(docs, length=16, records=32))
    made = sorted(shards.collect(), key=lambda r: r["shard"])
    total = sum(r["n_records"] for r in made)
    assert [r["first_slot"] for r in made] == [32 * i for i in range(len(made))] and all(r["n_records"] == 32 for r in made[:-1])
    assert all(len(r["payload"]) == r["n_records"] * r["stride"] for r in made)
    read = ordering.read_slots(shards, 0, total).collect()
    assert sorted(r["slot"] for r in read) == list(range(total))
    again = ordering.read_slots(shards, 40, 75).collect()
    assert sorted(again) == sorted(r for r in read if 40 <= r["slot"] < 75)
    enc = ordering.encoding(ordering.TOKENIZER)
    ids = defaultdict(list)
    for r in sorted(read, key=lambda r: r["seq"]):
        ids[r["doc_id"]].append(r["ids"])
    for i, t in rows:
        want = [*enc.encode_ordinary(t or ""), enc.n_vocab]
        got = [x for part in ids[-1 if i is None else i] for x in part]
        assert got == want * (2 if i == 5 else 1)
    assert enc.decode([x for p in ids[4] for x in p][:-1]) == rows[3][1]
    assert ordering.training_order(docs.filter("false")).collect() == []
    for n in (1, 7):
        assert sorted(ordering.training_order(docs.repartition(n), length=16, records=32).collect()) == made


def test_running_sums_over_hot_and_null_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(None if g == 2 else g, i, int(rng.integers(5))) for i, g in enumerate(np.minimum(rng.integers(0, 9, 500), 3))]
    rows = [(None if g is None else int(g), i, w) for g, i, w in rows]
    got = running_sum(spark.createDataFrame(rows, "g int, i int, w int"), ["g"], ["i"], {"upto": F.col("w")}, 7).collect()
    sums, alls = defaultdict(int), Counter()
    for g, _, w in rows:
        alls[g] += w
    want = {}
    for g, i, w in rows:
        sums[g] += w
        want[i] = (sums[g], alls[g])
    assert {r["i"]: (r["upto"], r["upto__all"]) for r in got} == want


def test_pipeline_stages(spark):
    docs = store(queries.table(spark, SF, "documents"))
    before = {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = dict(corpus_pipeline.STAGES)

    kept = store(stages["language"](spark, docs, SF))
    assert kept.columns == corpus_pipeline.COLUMNS and kept.count() > 0.99 * len(before)
    clean = store(stages["lines"](spark, kept, SF))
    from test_dedup import brute_lines
    own = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = {i: t for i, _, n, t in brute_lines(own) if n == 0 or t.strip(" \t\n\x0b\x0c\r")}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())

    single = store(stages["near duplicates"](spark, clean, SF))
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    fps = {i: simhash.fingerprint(t) for i, t in want.items()}
    ids = sorted(want)
    for n, i in enumerate(ids):  # whoever went has a smaller relative; no two who stayed are linked by fingerprints
        near = [j for j in ids[:n] if bin(fps[i] ^ fps[j]).count("1") <= 3]
        assert i not in left or not near
    for i in set(want) - set(left):
        assert any(simhash.similarity(want[i], want[j], 5) >= 0.5 or bin(fps[i] ^ fps[j]).count("1") <= 3 for j in ids if j != i)

    mixed = store(stages["mix"](spark, single, SF))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(single).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: c for i, c in copies.items() if c})
    pieces = stages["pack"](spark, mixed, SF).collect()
    check_bins(pieces, [(r["doc_id"], len(r["text"].split())) for r in mixed.collect()], 1024)


def test_pipeline_on_nulls_and_nothing(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the house and the garden", "en", None, 5), (3, "the house and the garden " * 9, "en", "s", 3)] * 2
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)):
        for _, stage in corpus_pipeline.STAGES:
            docs = store(stage(spark, docs, SF))
        assert docs.count() >= 0


def test_pipeline_mix_takes_every_row_for_itself(spark):
    rows = [(None if i % 4 == 0 else i // 3, f"{i} " + "word " * (i % 7), "en", "abc"[i % 3], i) for i in range(120)]
    docs = store(spark.createDataFrame(rows, DOCS))
    mixed = corpus_pipeline.mix_to_targets(spark, docs, SF)
    assert mixed.columns == corpus_pipeline.COLUMNS
    got = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert sum(got.values()) == sum(r["copies"] for r in mixing.mix_sources(docs).collect())
    assert sum(n for (i, _), n in got.items() if i is None) > 20
    numbered = store(docs.withColumn("number", F.col("n_chars")))
    want = Counter()
    for r in mixing.mix_sources(numbered, keep=["number"]).collect():
        want[rows[r["number"]][:2]] += r["copies"]
    assert got == +want
