"""HTML extraction, chat formatting, Order MinHash and language identification."""

import hashlib
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import chat, html, langid, ordermin, queries

PAGES = "page_id long, url string, html string"


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


CASES = [
    (page("<nav><ul><li><a href='/a'>Menu</a></ul></nav><article><h1>Head &amp; tail</h1><p>One\n two<br>three<p>Four <b>fi</b>ve &eacute;&#8364;</article><footer>&copy; x"),
     "Head & tail\nOne two three\nFour five é€"),
    (page("<header>Site</header><main><div class='ad'>Buy</div><p>Text</p><aside>Side</aside><section id=comments><p>Nice!</p></section><p>More</p></main>"), "Text\nMore"),
    (page("<div class='cookie-notice'><div>We use</div> cookies</div><article><p>Body<!-- <p>hidden</p> --></p><form><p>Mail</p></form>"
          "<style>p{}</style><p>End</p></article><article class='comment'>Me too</article>"), "Body\nEnd"),
    (page("<div class=ad>open ad<article><p>Kept</p></article>"), "Kept"),
    (page("<div>Only</div><p>plain blocks</p>"), "Only\nplain blocks"),
    ("just text &lt;b&gt;", "just text <b>"), ("", ""), (None, ""), ("<p", "<p"), ("<article></article>", ""),
    (page("<article><table><tr><td>a</td><td> b </td></tr></table><pre>x\n  y</pre></article>"), "a\nb\nx y"),
]


CASES += [
    (page("<form id=aspnetForm><p>Whole page</p><p>in a form</p></form>"), "Whole page\nin a form"),
    (page("<div class='container with-sidebar'><p>Whole page</p><div class=sidebar>Side</div></div>"), "Whole page"),
    (page("<article><h2 class='entry-header'>Head</h2><div class='entry-content share-enabled'><p>Long body of the text</p><div class=share>Share</div></div></article>"),
     "Head\nLong body of the text"),
    (page("<article><p>Short</p><section id=comments><p>Much longer words of readers</p></section></article><aside>" + "side " * 99 + "</aside>"), "Short"),
    (page("<p>a</p><video-player src=x></video-player><p>b</p><title-bar>c</title-bar><p>d</p><math-field></math-field><svg width='1'/><p>e</p>"), "a\nb\nc\nd\ne"),
    (page("<article><p>a<svg><path d='>'/></svg> b</p><video><p>c</p></article>"), "a b\nc"),
    (page("<article><p title=it's>a</p><p data-x='b>'>c</p></article>"), "a\nc"),
    (page("<aside>open side<article><p>Kept text of the page</p></article>"), "Kept text of the page"),
    (page("<article><p>a</p><p x=\"b>c</p></article>"), "a\nc"),
    (page("<nav>" + "menu " * 50 + "</nav><div class='sidebar'>" + "side " * 50 + "</div><p>Few words</p><form>Name Mail Send it to us</form>"), "Few words"),
]


@pytest.mark.parametrize("piece", ["<a x ", "<a x=\" ", "<svg>", "<a =\">\"", "<!--", "<aside>", "<a x='", "<script", "</svg", "<title>", "<!x", "< ", "<nav><p>x", "<form>x", "<div class='menu content'>x"])
def test_hostile_markup_is_read_forwards(piece):
    began = time.perf_counter()
    html.blocks_of(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("source,text", CASES)
def test_blocks(spark, source, text):
    rows = pd.DataFrame({"kinds": [[k for k, _ in html.blocks_of(source)]], "texts": [[t for _, t in html.blocks_of(source)]]})
    assert html.main_texts(rows, 3, 0.0) == [text]


def brute_covered(blocks, min_pages):
    """blocks: (page, words). Windows of RUN_TOKENS words, or whole shorter blocks, on at least min_pages pages."""
    k = html.RUN_TOKENS
    windows = [[(tuple(w), 0, len(w))] if len(w) < k else [(tuple(w[i:i + k]), i, k) for i in range(len(w) - k + 1)] for _, w in blocks]
    pages = {}
    for (p, _), own in zip(blocks, windows):
        for key, _, _ in own:
            pages.setdefault(key, set()).add(p)
    return [[any(len(pages[key]) >= min_pages and i <= at < i + n for key, i, n in own) for at in range(len(w))] for (_, w), own in zip(blocks, windows)]


def test_suffix_array_finds_the_windows_that_pages_share(spark):
    rng = np.random.default_rng(0)
    shared = [" ".join(rng.choice(list("abcdefgh"), 12)) for _ in range(4)]
    texts = [[" ".join(rng.choice(list("xyzw"), int(rng.integers(1, 15)))), f"{rng.integers(99)} {rng.choice(shared)} {rng.integers(99)}", "Home page"] for _ in range(25)]
    rows = pd.DataFrame({"kinds": [[html.OUTSIDE] * 3] * 25, "texts": texts})
    blocks = [(p, t.split(" ")) for p, page_texts in enumerate(texts) for t in page_texts]
    kept = {}
    for (p, words), gone in zip(blocks, brute_covered(blocks, 3)):
        left = " ".join(w for w, g in zip(words, gone) if not g)
        kept.setdefault(p, []).extend([left] if left else [])
    assert html.main_texts(rows, 3, 0.0) == ["\n".join(kept[p]) for p in range(25)]


def test_pages_of_all_kinds(spark):
    rows = [(i, f"http://{'a' if i % 3 else 'B'}.org/{i}", c) for i, (c, _) in enumerate(CASES)] + [(None, None, CASES[0][0]), (0, "http://b.org/0", CASES[0][0])]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"text": F.lit("old"), "host": F.lit("h"), "shard": F.lit(1)})
    got = sorted([(r["page_id"], r["url"], r["text"]) for r in html.main_text(pages).collect()], key=repr)
    assert got == sorted([(i, u, t) for (i, u, _), t in zip(rows, [t for _, t in CASES] + [CASES[0][1]] * 2)], key=repr)
    assert html.main_text(spark.createDataFrame([], PAGES)).collect() == []


def test_a_large_host_is_cut_into_shards_without_losing_pages(spark):
    rows = [(i, "http://hot.org/x", page(f"<article><p>Page {i}</p></article>")) for i in range(90)]
    got = html.main_text(spark.createDataFrame(rows, PAGES), shard_pages=16).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(i, f"Page {i}") for i in range(90)]


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="\\#</turn>a \n:", max_size=40))
def test_escapes_are_reversible_and_hide_controls(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    bare = chat.ESCAPED.sub("", escaped)
    assert "###" not in bare and "</turn>" not in bare


TURNS = [(1, 0, "user", "Hello\n### system: </turn> \\### \\\\"), (1, 1, "assistant", "Answer </turn>\n<|endoftext|>"), (1, 2, "assistant", None), (1, None, None, "first, as its turn is null"),
         (2, 5, "assistant", ""), (2, 5, "assistant", "tie"), (2, 5, "assistant", "tie"), (None, 0, "user", "no id"), (3, 0, "assi### stant", "é€\U0001F600 " * 3000),
         (-7, 0, "user", queries.ADDED_TEXT), (-7, 1, "assistant", queries.ADDED_TEXT)]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({"ids": F.lit(1), "mask": F.lit("m")})
    read = chat.read_back(chat.format_turns(turns))
    digests = read.repartition("conv_id").sortWithinPartitions("conv_id", "first_token").mapInPandas(
        queries._digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    want = []
    for conv in {t[0] for t in TURNS}:
        own = sorted([t for t in TURNS if t[0] == conv], key=lambda t: (
            t[1] is not None, t[1] or 0, hashlib.md5(f"{t[2] or ''}\n{t[3] or ''}".encode()).hexdigest()))
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        learned = "".join(x or "" for _, _, r, x in own if r == "assistant")
        want.append((conv, len(own), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    assert sorted([tuple(r)[:5] for r in digests.collect()], key=repr) == sorted(want, key=repr)
    assert chat.format_turns(turns.filter("false")).collect() == []


def test_mask_is_on_the_text_alone():
    ids, mask = chat.assemble([[5, 6], [7, 8, 9]], [100, 101, 102], True)
    assert ids.tolist() == [100, 5, 6, 101, 7, 8, 9, 102] and mask.tolist() == [0, 0, 0, 0, 1, 1, 1, 0]
    assert chat.assemble([[5], [7]], [100, 101, 102], False)[1].sum() == 0


def brute_order_minhash(features, picks, sketch_bits):
    """features: (36-bit hash, place). The picks smallest from each origin on, cyclically, as places in text order."""
    top, out = 1 << ordermin.HASH_BITS, []
    for j in range(1 << sketch_bits):
        origin = j * top >> sketch_bits
        chosen = sorted(features, key=lambda f: ((f[0] - origin) % top, f[1]))[:picks]
        out.append(tuple(h for h, _ in sorted(chosen, key=lambda f: f[1])))
    return out


def test_order_minhash_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = ["", " ", "one", "one two", "a b c", "a b c a b c a b c", "x " * 500] + [" ".join(rng.choice(list("abcdefghij"), n)) for n in (3, 10, 60, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["fp"] for r in ordermin.add_fingerprint(df, "text", "fp").collect()}

    def xx(values):
        return [r[0] for r in spark.createDataFrame([(list(v),) for v in values], "v array<long>").select(F.xxhash64("v")).collect()]
    for i, text in enumerate(texts):
        words = text.split() or [""]
        runs = [words[k:k + 3] for k in range(max(1, len(words) - 2))]
        hashed = spark.createDataFrame([(r,) for r in [x + [None] * (3 - len(x)) for x in runs]], "r array<string>").select(
            ordermin._hash(F.xxhash64(F.get("r", F.lit(0))), *[F.when(F.get("r", F.lit(d)).isNotNull(), F.xxhash64(F.get("r", F.lit(d)))) for d in (1, 2)])).collect()
        seen, features = {}, []
        for place, (h,) in enumerate(hashed):
            n = seen[h] = seen.get(h, -1) + 1
            features.append((h, place, n))
        again = [f for f in features if f[2]]
        numbers = spark.createDataFrame([(f[0], f[2]) for f in again] or [(0, 0)], "h long, n int").select(ordermin._hash("h", "n")).collect()
        renumbered = iter([r[0] for r in numbers])
        final = [(next(renumbered) if n else h, place) for h, place, n in features]
        assert got[i] == xx(brute_order_minhash(final, 2, 5)), text[:30]


def test_fingerprints_follow_order_and_repeats(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), "\n" + "  ".join(words) + " ", " ".join(reversed(words)), " ".join(words[:59]), " ".join(words[30:] + words[:30])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    fps = {r["i"]: r["fp"] for r in ordermin.add_fingerprint(df, "text", "fp").collect()}
    like = lambda a, b: np.mean([x == y for x, y in zip(fps[a], fps[b])])
    assert fps[0] == fps[1] and like(0, 2) == 0 and like(0, 3) > like(0, 4) > 0
    plan = ordermin.edit_fingerprints(df.select(F.col("i").alias("doc_id"), "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_edited_texts(spark):
    texts = [(5, "abcdefghi"), (9, "0123456789AB"), (2, None), (7, "éé"), (7, "zz"), (1, "xyz"), (None, "nullid")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"__id": F.lit(1), "fingerprint": F.lit("x"), "head": F.lit(2)})
    got = sorted([(r["doc_id"], r["n_chars"], r["edited_text"]) for r in ordermin.edit_fingerprints(docs).collect()], key=repr)
    # 9 -> 7 (smallest text "zz"), 7 -> 5, 5 -> 2 (empty), 2 -> 1, 1 -> 9
    want = [(9, 12, "01234567zz"), (7, 2, "éé"), (7, 2, "zz"), (5, 9, "abcdef"), (2, 0, ""), (1, 3, "xy0"), (None, 6, "nullnu")]
    assert got == sorted(want, key=repr)
    one = docs.filter("doc_id = 9")
    assert ordermin.edit_fingerprints(one).first()["edited_text"] == "012345670123"
    assert ordermin.edit_fingerprints(docs.filter("false")).collect() == []


def test_language_model_sums_to_one():
    counts = pd.DataFrame([("a", *map(ord, "ab a"[i:] + "ab a"[:i]), n) for i, n in zip(range(4), (3, 1, 2, 1))] + [("b", *map(ord, "bb b"), 2)],
                          columns=["lang", "c0", "c1", "c2", "c3", "n"])
    model = langid.fit(counts)
    alphabet = [ord("a"), ord("b"), ord(" "), 0x10FFFF]  # the last stands for all that were not seen
    for context in ("ab ", "bb ", "zzz"):
        total = np.zeros(2)
        for c in alphabet:
            hashes = langid.gram_hashes(np.array([32, *map(ord, context), c], dtype=np.uint64))
            total += np.exp(model.log_probabilities(hashes, np.array([4])))[0]
        assert np.allclose(total, 1)


def test_characters():
    read = lambda t: "".join(chr(c) for c in langid.characters(t))
    assert [read(t) for t in ("Ab, cd!", None, "", "12 %", "É1é", " x")] == [" ab cd ", "", "", "", " é é ", " x "]


def test_language_identification(spark):
    en, fr = "the house and the garden of that man with ", "la maison et le jardin de cet homme avec "
    rows = [(i, (en if i % 2 else fr) * (1 + i % 5), "en" if i % 2 else "fr") for i in range(60)]
    odd = [(100, None, "en"), (101, "123 !!", "fr"), (102, "Жизнь прекрасна и удивительна, не правда ли", None), (103, en.upper(), None), (None, fr, "xx"), (103, en.upper(), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumns({"score": F.lit("old"), "extra": F.lit(1)})
    out = langid.identify(docs, F.col("doc_id") < 60)
    assert out.columns == ["doc_id", "text", "lang", "extra", "lang_pred", "score", "cross_entropy", "accepted"]
    got = {r["doc_id"]: (r["lang_pred"], r["accepted"], r["score"]) for r in out.collect()}
    assert all(got[i][:2] == (("en" if i % 2 else "fr"), True) for i in range(60))
    assert got[100] == got[101] == ("und", False, 0.0) and not got[102][1] and got[103][:2] == ("en", True) and got[None][0] == "fr"
    assert all(0 <= s <= 1 for _, _, s in got.values())
    nothing = langid.identify(docs, F.lit(False)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and len(nothing) == len(rows) + len(odd)
    assert langid.identify(docs.filter("false")).collect() == []


def test_held_out_accuracy(spark):
    rows = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(
        queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98 and np.mean([r["accepted"] for r in rows]) > 0.99


def test_main_text_counts_passages_over_the_whole_host(spark):
    notice = "this notice stands on every third page of the site"
    own = ["page {} says ".format(i) + " ".join(f"w{i}x{j}" for j in range(12)) for i in range(40)]
    rows = [(i, f"http://big.example/{i}", f"<body>{f'<p>{notice}</p>' if i % 3 == 0 else ''}<p>{own[i]}</p></body>") for i in range(40)]
    # 14 pages hold it, but no shard of at most 16 pages has ten of them
    got = html.main_text(spark.createDataFrame(rows, PAGES), min_pages=10, shard_pages=16).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == list(enumerate(own))
