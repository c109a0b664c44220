"""Benchmark decontamination: a broadcast set of hashed test n-grams, scanned against every window of every document.

A task hashes the words of a slice of texts at once (prefix sums of a polynomial over the bytes), combines them to windows and looks those up
in a sorted array of the benchmark's hashes. A window that is found is then compared word by word, so no hash collision counts. The
benchmark is dealt into slices of at most ``WINDOWS_AT_ONCE`` windows; each is broadcast for one scan of the documents, and only
with several slices are the findings of a document brought together by a shuffle of its hits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, store

#: Words of a window; an item with fewer is one window.
WINDOW = 10
#: Windows of a broadcast (about 100 MB of text and hashes at most for words of usual length).
WINDOWS_AT_ONCE = 1_000_000
#: Bytes whose prefix sums are held at once.
PIECE = 1 << 20
#: An odd factor of the polynomial over bytes, its inverse modulo 2**64, and the factor over words.
FACTOR, OVER_WORDS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
INVERSE = pow(FACTOR, -1, 1 << 64)

FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>"

_BYTES = np.arange(256)
#: Byte of a word: digits, letters, everything beyond ASCII.
_IS_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def _powers(base: int) -> np.ndarray:
    powers = np.full(PIECE + 1, base, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


class Words:
    """The words of several texts that follow each other in ``data``: lowered bytes, starts, ends, text number and hash of each."""

    up, down = _powers(FACTOR), _powers(INVERSE)

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.bytes = _LOWER[data]
        starts, ends, begun, ended, scale = [], [], [], [], []
        border = np.zeros(PIECE + 1, dtype=bool)
        inside, total, high, low = False, 0, 1, 1
        for at in range(0, len(data), PIECE):
            part = self.bytes[at:at + PIECE]
            n = len(part)
            border[:] = False
            first, last = np.searchsorted(offsets, [at, at + n])
            border[offsets[first:last] - at] = True
            word = _IS_WORD[part]
            before = np.concatenate([[inside], word[:-1]])
            start = np.flatnonzero(word & (~before | border[:n]))
            end = np.flatnonzero(before & (~word | border[:n]))
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[:n], dtype=np.uint64)])
                sums = sums * np.uint64(high) + np.uint64(total)
                scale.append(self.down[start] * np.uint64(low))
            starts.append(start + at)
            ends.append(end + at)
            begun.append(sums[start])
            ended.append(sums[end])
            inside, total = bool(word[-1]), int(sums[-1])
            high, low = high * int(self.up[n]) % (1 << 64), low * int(self.down[n]) % (1 << 64)
        if inside:
            ends.append(np.array([len(data)]))
            ended.append(np.array([total], dtype=np.uint64))
        whole = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.start, self.end = whole(starts, np.int64), whole(ends, np.int64)
        with np.errstate(over="ignore"):
            h = (whole(ended, np.uint64) - whole(begun, np.uint64)) * whole(scale, np.uint64)
            for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        self.hash = h ^ (h >> np.uint64(33))
        self.text = np.searchsorted(offsets, self.start, side="right") - 1

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows inside one text, and their hashes."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, length, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length):
                h = h * np.uint64(OVER_WORDS) + self.hash[k:k + n]
        own = self.text[:n] == self.text[length - 1:]
        return np.flatnonzero(own), h[own]

    def spelled(self, first: int, length: int) -> bytes:
        return b" ".join(self.bytes[self.start[i]:self.end[i]].tobytes() for i in range(first, first + length))


def words_of(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a column of texts (null: none), its bytes and where each text starts."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = whole.buffers()
    borders = np.frombuffer(offsets, dtype=np.int64)[whole.offset:whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[borders[0]:borders[-1]] if data is not None else np.zeros(0, np.uint8)
    return Words(raw, borders[:-1] - borders[0]), raw, borders - borders[0]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id") -> DataFrame:
    """(item, words): the distinct windows of each item, words lowered and joined by one space; item is null where the id is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            words, _, _ = words_of(batch.column(1))
            length = min(window, len(words.hash))
            for at in range(0, max(len(words.hash) - length + 1, 0) if length else 0, 10_000):
                spelled = [words.spelled(i, length).decode("utf-8", "replace") for i in range(at, min(at + 10_000, len(words.hash) - length + 1))]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[0].as_py()] * len(spelled), pa.string()), pa.array(spelled, pa.string())], ["item", "words"])
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "item string, words string").distinct()


def lookup_table(words: Sequence[str], items: Sequence[str | None]) -> dict:
    """What is broadcast: window hashes in order, the windows and items in that order, a bitmap over the first 20 bits, the lengths that occur."""
    spelled = pa.array(words, pa.string())
    found, _, _ = words_of(spelled)
    counts = np.bincount(found.text, minlength=len(spelled))
    hashes = np.zeros(len(spelled), dtype=np.uint64)
    for length in np.unique(counts):
        at, h = found.windows(int(length))
        full = counts[found.text[at]] == length
        hashes[found.text[at[full]]] = h[full]
    order = np.argsort(hashes, kind="stable")
    seen = np.zeros(1 << 20, dtype=bool)
    seen[hashes >> np.uint64(44)] = True
    return {"hashes": hashes[order], "words": spelled.cast(pa.binary()).take(pa.array(order)), "items": pa.array(items, pa.string()).take(pa.array(order)),
            "seen": seen, "lengths": [int(n) for n in np.unique(counts)]}


def occurrences(words: Words, known: dict) -> Iterator[tuple[int, int, set[str]]]:
    """(first word, length, items) of each window of the texts that is one of the benchmark's, word by word."""
    for length in known["lengths"]:
        at, hashes = words.windows(length)
        maybe = known["seen"][hashes >> np.uint64(44)]
        at, hashes = at[maybe], hashes[maybe]
        low, high = (np.searchsorted(known["hashes"], hashes, side=s) for s in ("left", "right"))
        for i in np.flatnonzero(high > low):
            spelled = words.spelled(int(at[i]), length)
            rows = [r for r in range(low[i], high[i]) if known["words"][r].as_py() == spelled]
            if rows:
                yield int(at[i]), length, {item for r in rows if (item := known["items"][r].as_py()) is not None}


def _scanner(known, keep_text: bool):
    """Per text: its words, those hit, the items met and the runs of words hit (numbers of first and last word, from 0). ``known`` is a broadcast."""
    span = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            words, _, _ = words_of(batch.column(1))
            total = np.bincount(words.text, minlength=batch.num_rows)
            first = np.concatenate([[0], np.cumsum(total)])
            steps, items = np.zeros(len(words.hash) + 1, dtype=np.int64), [set() for _ in range(batch.num_rows)]
            for at, length, met in occurrences(words, known.value):
                steps[at] += 1
                steps[at + length] -= 1
                items[words.text[at]] |= met
            hit = np.cumsum(steps[:-1]) > 0
            hits, spans = np.bincount(words.text[hit], minlength=batch.num_rows), []
            for n in range(batch.num_rows):
                own = hit[first[n]:first[n + 1]] if hits[n] else np.zeros(0, bool)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]).astype(np.int8)))
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])])
            columns = {batch.schema.names[0]: batch.column(0), "n_words": pa.array(total, pa.int64()), "n_hit": pa.array(hits, pa.int64()),
                       "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(span))}
            yield pa.RecordBatch.from_pydict(columns | ({"text": batch.column(1)} if keep_text else {}))
    return run


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the runs of words in ``spans``; null stays null."""
    for batch in in_slices(batches):
        texts, spans = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("spans")).to_pylist()
        words, raw, borders = words_of(texts)
        first, left = np.searchsorted(words.text, np.arange(batch.num_rows)), []
        for n, runs in enumerate(spans):
            at, parts = borders[n], []
            for s in runs:
                parts.append(raw[at:words.start[first[n] + s["first"]]].tobytes())
                at = words.end[first[n] + s["last"]]
            left.append(b"".join([*parts, raw[at:borders[n + 1]].tobytes()]).decode("utf-8", "replace") if texts[n].is_valid else None)
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(left, pa.string()))


def _merged(spans: Column) -> Column:
    """Runs of words in order, those that overlap or touch as one."""
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<first:long,last:long>>"), lambda runs, s: F.when(
        (F.size(runs) > 0) & (s["first"] <= F.element_at(runs, -1)["last"] + 1),
        F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(
            F.element_at(runs, -1)["first"].alias("first"), F.greatest(F.element_at(runs, -1)["last"], s["last"]).alias("last"))))
    ).otherwise(F.concat(runs, F.array(s))))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: bool = False,
                       windows_at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_hit (words inside any occurrence of a window of the benchmark), items (ids, as strings, whose
    windows occur, sorted), spans (runs of words hit: first and last word, from 0); with ``remove`` also text, without those runs.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lowered; a window is ``window`` consecutive words of an item, all its
    words if it has fewer; an item without words, or a null or empty one, has none. A null or empty document has no words, and its text stays.
    Items of equal text count each, items of equal id once; an item without an id marks words but is not in ``items``. Rows are judged one by
    one: null and repeated doc_ids stay as they are. Other columns are not read. An empty benchmark hits nothing, an empty table gives an
    empty result. A text of any length is read whole, in pieces.
    """
    spark = docs.sparkSession
    pairs = store(benchmark_windows(benchmark, window))
    slices = max(1, -(-pairs.count() // windows_at_once))
    dealt = F.pmod(F.xxhash64("words", "item"), F.lit(slices))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def scan(rows: DataFrame, n: int, keep_text: bool = False) -> DataFrame:
        own = pairs.filter(dealt == n).toArrow()
        known = spark.sparkContext.broadcast(lookup_table(own["words"].to_pylist(), own["item"].to_pylist()))
        key = rows.schema[0]
        return rows.mapInArrow(_scanner(known, keep_text), f"{key.name} {key.dataType.simpleString()}, {FOUND}" + ", text string" * keep_text)

    if slices == 1:
        found = scan(texts, 0, remove)
    else:  # the findings of all slices meet by row; a row without any is there from the first
        numbered = store(texts.withColumn("__row", F.monotonically_increasing_id()))
        parts = [scan(numbered.select("__row", "text"), n) for n in range(slices)]
        parts = [store(part if n == 0 else part.filter("n_hit > 0")) for n, part in enumerate(parts)]
        met = reduce(DataFrame.union, parts).groupBy("__row").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            _merged(F.flatten(F.collect_list("spans"))).alias("spans"))
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
        found = numbered.join(met, "__row").select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans", *(["text"] if remove else []))
    return found.mapInArrow(_cutter, found.schema) if remove else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: float = 0.0) -> DataFrame:
    """doc_id and text of the rows of which at most the share ``most`` of words is hit; cases as in ``find_contamination``."""
    found = find_contamination(docs, benchmark, window, remove=True)
    whole = found.filter(F.col("n_hit") <= F.lit(most) * F.col("n_words"))
    return whole.select("doc_id", "text")
