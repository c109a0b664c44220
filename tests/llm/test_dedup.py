"""Line dedup and SimHash near-dedup against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import linededup, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)


def brute_lines(texts, min_chars=20, min_docs=3):
    keys = lambda t: [line.strip(SPACES).translate(LOWER) for line in (t or "").split("\n")]
    holders = defaultdict(set)
    for i, t in texts:
        for k in keys(t):
            if i is not None and len(k) >= min_chars:
                holders[k].add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [line for line, k in zip(lines, keys(t)) if i is None or len(holders[k]) < min_docs or i == max(holders[k])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept) if t is not None else None))
    return sorted(out, key=repr)


LONG = "A passage that many documents share, é"
TEXTS = [(1, f"{LONG}\nown line of the first document"), (2, f"  {LONG.upper().replace('É', 'é')}\t\n{LONG}\nx"), (3, LONG), (4, None), (5, ""),
         (6, "short\nshort\nshort"), (7, "short"), (8, "short"), (9, f"{LONG}\r\n\n{LONG}"), (None, LONG), (10, "é" * 19), (11, "é" * 19), (12, "é" * 19),
         (13, "é" * 20), (14, "é" * 20), (15, "é" * 20), (16, "twice in one document only\n" * 4), (17, "twice in one document only"),
         (18, "word " * 20000), (3, LONG), (3, "another text of the same document, and longer than twenty"), (19, "A\u2028B" * 10)]


def rows(df):
    return sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()], key=repr)


def test_line_dedup_matches_brute_force(spark):
    assert rows(linededup.dedup_lines(table(spark, TEXTS))) == brute_lines(TEXTS)


def test_line_dedup_on_random_lines(spark):
    rng = np.random.default_rng(5)
    lines = [f"line number {i} of the pool of lines" for i in range(60)]
    texts = [(i, "\n".join(rng.choice(lines, rng.integers(1, 9)))) for i in range(80)]
    assert rows(linededup.dedup_lines(table(spark, texts))) == brute_lines(texts)


def test_line_dedup_keeps_other_columns_and_replaces_its_own(spark):
    docs = table(spark, TEXTS[:3]).withColumns({"n_lines": F.lit("old"), "h": F.lit(7), "key": F.lit("k")})
    out = linededup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "h", "key", "n_lines", "n_dropped"]
    assert {(r["h"], r["key"]) for r in out.collect()} == {(7, "k")}


def test_line_dedup_of_an_empty_table(spark):
    assert linededup.dedup_lines(table(spark, [])).collect() == []


def test_second_filter_never_misses_a_repeat():
    rng = np.random.default_rng(1)
    once, twice = linededup.Bloom(1 << 10), linededup.Bloom(1 << 10)  # far too small: only false alarms may follow
    h = rng.integers(-1 << 62, 1 << 62, 4000)
    for part in np.array_split(np.concatenate([h, h[:500]]), 7):
        twice.add(part[once.holds(part)])
        once.add(part)
    assert once.holds(h).all() and twice.holds(h[:500]).all()


def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(texts, radius=3):
    fps = [brute_fingerprint(t) for _, t in texts]
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {c: min((d for (d, _), x in zip(texts, label) if x == c and d is not None), default=None) for c in set(label)}
    return sorted([(d, f"{fp:016x}", least[c]) for (d, _), fp, c in zip(texts, fps, label)], key=repr)


def components(df):
    return sorted([tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()], key=repr)


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(40):
        words = list(rng.choice(vocabulary, 300))
        for j in range(int(rng.integers(1, 5))):
            texts.append((100 * i + j, " ".join(words)))
            words[int(rng.integers(300))] = "changed"
    texts += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "One two"), (9004, "one\u00a0two"), (9005, "one  TWO"), (None, "one two"), (9003, "One two"),
              (9006, "É é"), (9007, "long " * 70000), (None, "alone without an id")]
    docs = table(spark, texts).withColumns({"fp": F.lit(1), "root": F.lit("r"), "fingerprint": F.lit("f")})
    assert components(simhash.near_duplicates(docs)) == brute_components(texts)


def test_near_duplicates_of_an_empty_table(spark):
    assert simhash.near_duplicates(table(spark, [])).collect() == []


@pytest.mark.parametrize("radius,blocks", [(1, 2), (3, 4), (3, 5), (6, 8)])
def test_links_connect_what_all_pairs_connect(spark, radius, blocks):
    rng = np.random.default_rng(radius)
    fps = {int(x) for x in rng.integers(0, 1 << 62, 60)}
    for x in list(fps)[:20]:  # groups whose members drift apart bit by bit
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b)
            fps.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, simhash.block_masks(radius, blocks), 8).collect()

    def groups(pairs):
        label = {x: x for x in signed}
        for a, b in pairs:
            a, b = label[a], label[b]
            if a != b:
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
        return label
    near = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= radius]
    assert groups([(r["a"], r["b"]) for r in links]) == groups(near)


def test_large_runs_return_a_spanning_set():
    center = 0x0123456789ABCDEF
    fps = np.array([center] + [center ^ 1 << i for i in range(64)] + [center ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)], dtype=np.uint64)
    a, b = simhash.links_of(np.zeros(len(fps)), fps, np.zeros(len(fps), dtype=int), 3)
    assert len(a) == len(fps) - 1
    assert all(bin(int(x) ^ int(y)).count("1") <= 3 for x, y in zip(a, b))


def test_similar_documents_are_read_before_they_are_linked(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for i in range(60):
        words = list(rng.choice(vocabulary, 250))
        texts.append((10 * i, " ".join(words)))
        copy = list(words)
        for at in rng.choice(250, i // 6, replace=False):
            copy[at] = "other"
        texts.append((10 * i + 1, " ".join(copy)))
    texts += [(5000, None), (5001, ""), (None, texts[0][1]), (5002, "a b c"), (5002, "x y z")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table(spark, texts)).collect()}
    text = dict(texts)
    alike = [simhash.similarity(text[10 * i], text[10 * i + 1], 5) >= 0.8 for i in range(60)]
    close = [bin(brute_fingerprint(text[10 * i]) ^ brute_fingerprint(text[10 * i + 1])).count("1") <= 3 for i in range(60)]
    joined = [got[10 * i + 1] == 10 * i for i in range(60)]
    assert all(j <= (a or c) for j, a, c in zip(joined, alike, close)) and all(j for j, c in zip(joined, close) if c)
    assert sum(j and a for j, a in zip(joined, alike)) >= 0.9 * sum(alike) > 20
    assert got[None] == 0 and got[5000] == got[5001] == 5000


def brute_similar(texts, least=0.8, width=5, radius=3):
    sets = [set(simhash.shingle_hashes(t, width)) for _, t in texts]
    fps = [simhash.fingerprint(t) for _, t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) > 0:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least_id = {c: min(d for n, (d, _) in enumerate(texts) if root(n) == c) for c in {root(n) for n in range(len(texts))}}
    return {d: least_id[root(n)] for n, (d, _) in enumerate(texts)}


def test_edited_copies_of_one_document_are_found_through_it(spark):
    """Copies share 0.8 with the original only, about 0.7 with each other."""
    rng = np.random.default_rng(21)
    vocabulary = [f"w{i}" for i in range(5000)]
    original = list(rng.choice(vocabulary, 300))
    texts = [(1000, " ".join(original))]
    for i in range(400):
        copy = list(original)
        for at in np.linspace(10, 285, 5).astype(int) + rng.integers(-10, 10, 5):
            copy[at] = f"edit{i}x{at}"
        texts.append((i, " ".join(copy)))
    for i in range(200):  # others, some of them in pairs around the limit
        words = list(rng.choice(vocabulary, 200))
        texts.append((2000 + 2 * i, " ".join(words)))
        words[:i % 20 * 3] = ["other"] * (i % 20 * 3)
        texts.append((2001 + 2 * i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table(spark, texts)).collect()}
    want = brute_similar(texts)
    assert sum(c == 0 for c in want.values()) == 401
    assert got == want


def test_no_candidate_is_crowded_out_by_nearer_ones(spark):
    """Groups of 60 copies: many are nearer in bits to each other than to the original, but share 0.8 with it alone."""
    rng = np.random.default_rng(4)
    texts = []
    for g in range(4):
        original = list(rng.choice([f"w{i}" for i in range(5000)], 300))
        texts.append((100 * g + 99, " ".join(original)))
        for i in range(60):
            copy = list(original)
            for at in np.linspace(10, 285, 5).astype(int) + rng.integers(-10, 10, 5):
                copy[at] = f"edit{i}x{at}"
            texts.append((100 * g + i, " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table(spark, texts)).collect()}
    assert got == brute_similar(texts) == {d: d // 100 * 100 for d, _ in texts}
