"""Benchmark decontamination against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import decontam

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    known = {}
    for item, text in items:
        own = words(text)
        for i in range(max(len(own) - window, 0) + 1 if own else 0):
            known.setdefault(tuple(own[i:i + window]), set()).add(item)
    out = []
    for doc_id, text in docs:
        own, hit, met = words(text), set(), set()
        for length in {len(k) for k in known}:
            for i in range(len(own) - length + 1):
                if (k := tuple(own[i:i + length])) in known:
                    hit |= set(range(i, i + length))
                    met |= known[k]
        out.append((doc_id, len(own), len(hit), sorted(str(m) for m in met if m is not None)))
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def found(df):
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in df.collect()], key=repr)


ITEM = "One two three four FIVE six seven eight nine ten eleven twelve"
ITEMS = [(1, ITEM), (2, "zero " + ITEM), (2, ITEM), (-5, "Short item"), (None, "unnamed item of four"), (7, None), (8, ""), (9, "?!"), (10, "über-größe 42"), (11, "a a")]
DOCS = [(1, None), (2, ""), (3, ITEM.lower()), (4, f"x {ITEM[:-7]} y"), (5, "one two three four five six seven eight nine"), (6, "a short, ITEM; short item."),
        (7, "an unnamed item of four words"), (8, "ÜBER größe 42 über grÖße 42 über größe 42"), (9, f"{ITEM} {ITEM}"), (9, "the same id"), (None, ITEM), (10, "a a a a b a a"),
        (11, "  \t\n... "), (12, "one\ttwo|three/four\nfive six'seven\"eight nine`ten"), (13, "wo" + ITEM), (14, "word " * 30_000 + ITEM)]


@pytest.mark.parametrize("at_once", [decontam.WINDOWS_AT_ONCE, 4])
def test_matches_brute_force(spark, at_once):
    docs, items = tables(spark, DOCS, ITEMS)
    assert found(decontam.find_contamination(docs, items, windows_at_once=at_once)) == brute(DOCS, ITEMS)


@pytest.mark.parametrize("at_once", [decontam.WINDOWS_AT_ONCE, 40])
def test_random_words_of_a_small_vocabulary(spark, at_once):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(["a", "b", "c"], n))
    items = [(i, text(rng.integers(1, 9))) for i in range(15)]
    docs = [(i, text(rng.integers(0, 60))) for i in range(150)]
    d, b = tables(spark, docs, items)
    assert found(decontam.find_contamination(d, b, window=5, windows_at_once=at_once)) == brute(docs, items, 5)


@pytest.mark.parametrize("at_once", [decontam.WINDOWS_AT_ONCE, 4])
def test_spans_are_removed(spark, at_once):
    docs, items = tables(spark, [(1, f"Keep this. {ITEM}; and that!"), (2, None), (3, "clean, é"), (4, f"{ITEM} {ITEM}"), (5, ""), (6, f"{ITEM} -- {ITEM} short item")], ITEMS)
    got = {r["doc_id"]: (r["text"], [tuple(s) for s in r["spans"]]) for r in decontam.find_contamination(docs, items, remove=True, windows_at_once=at_once).collect()}
    assert got == {1: ("Keep this. ; and that!", [(2, 13)]), 2: (None, []), 3: ("clean, é", []), 4: ("", [(0, 23)]), 5: ("", []), 6: ("", [(0, 25)])}


def test_documents_are_dropped(spark):
    docs, items = tables(spark, [(1, f"Keep this. {ITEM}"), (2, None), (3, "clean"), (4, "short item in a long clean text of many other words")], ITEMS)
    assert sorted((r[0], r[1]) for r in decontam.drop_contaminated(docs, items).collect()) == [(2, None), (3, "clean")]
    assert sorted(r[0] for r in decontam.drop_contaminated(docs, items, most=0.3).collect()) == [2, 3, 4]


def test_empty_tables_and_other_columns(spark):
    docs, items = tables(spark, DOCS, ITEMS)
    none, nothing = docs.limit(0), items.limit(0)
    assert found(decontam.find_contamination(none, items)) == []
    assert found(decontam.find_contamination(docs, nothing)) == brute(DOCS, [])
    clashing = docs.selectExpr("*", "'x' AS items", "1 AS n_words", "2 AS item_id", "3 AS __row", "'y' AS words")
    assert found(decontam.find_contamination(clashing, items.selectExpr("*", "1 AS doc_id", "2 AS words"))) == brute(DOCS, ITEMS)


def test_pieces_and_collisions(spark):
    texts = [f"{ITEM} " * 5, None, "x", "ab" * 50, ""]
    whole, _, _ = decontam.words_of(pa.array(texts))
    piece, powers = decontam.PIECE, (decontam.Words.up, decontam.Words.down)
    try:
        decontam.PIECE = 7
        decontam.Words.up, decontam.Words.down = decontam._powers(decontam.FACTOR), decontam._powers(decontam.INVERSE)
        parts, _, _ = decontam.words_of(pa.array(texts))
    finally:
        decontam.PIECE, (decontam.Words.up, decontam.Words.down) = piece, powers
    for name in ("start", "end", "hash", "text"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name))
    # a window whose hash is known but whose words differ does not count
    known = decontam.lookup_table(["a b"], ["1"])
    known["words"] = pa.array([b"a c"])
    assert list(decontam.occurrences(decontam.words_of(pa.array(["x a b"]))[0], known)) == []


def test_one_hot_passage(spark):
    docs = [(i, f"doc {i} {ITEM} end") for i in range(3000)]
    d, b = tables(spark, docs, ITEMS)
    assert found(decontam.find_contamination(d, b)) == brute(docs, ITEMS)
