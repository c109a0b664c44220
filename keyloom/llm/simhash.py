"""SimHash near-duplicates, compared on bit planes.

Fingerprints that agree on enough blocks of bits meet in a bucket. Inside a task the fingerprints of many buckets lie
vertically: plane b holds bit b of all of them, 64 to a machine word. Sliding the planes by one lane after another compares
each fingerprint with its neighbours; carry-save counters add up 64 differences of all lanes at once, and a word of lanes is left
as soon as all its distances exceed the radius. A task returns a spanning set of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graphs import connected_components
from .common import in_slices, store

#: Rows of a bucket that one task compares; larger buckets are cut into chunks that meet pair by pair.
CHUNK_ROWS = 16_384
SHINGLES_AT_ONCE = 65_536
SHIFTS_AT_ONCE = 64
#: Rows of a bucket of the shingle join that one salt holds.
SALT_ROWS = 1024
#: Sets and shingles of a chunk of texts that are read together.
BLOCK_SETS, BLOCK_SHINGLES = 512, 200_000
#: Bits of the map of wanted texts, broadcast in words of 64.
NEEDED_BITS = 1 << 24
#: Shingles that so many documents of one in SAMPLE_ONE_IN hold go last in prefixes.
SAMPLE_ONE_IN, COMMON_IN_SAMPLE, COMMON_MOST = 20, 10, 65_536


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 (seed 42) of the shingles, repeats included; of the whole sequence if it is shorter; none of an empty text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, space = xxhash.xxh64_intdigest, b" "
    if len(words) <= width:
        return [digest(space.join(words), 42)] if words else []
    return [digest(space.join(s), 42) for s in zip(*(words[i:] for i in range(width)))]


def fingerprint(text: str | None, width: int = 3) -> int:
    """A bit is 1 if more than half of the shingle hashes have it; no words give 0."""
    hashes = shingle_hashes(text, width)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = np.array(hashes[at:at + SHINGLES_AT_ONCE], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((ones * 2 > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``; ``fp`` holds the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - radius`` out of ``blocks`` runs of bits. Two fingerprints within ``radius`` differ in at
    most ``radius`` runs, so they agree under at least one mask."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    runs = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(runs, blocks - radius)]


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit b of 64 fingerprints in each word of row b, with a word of padding."""
    lanes = -(-len(fps) // 64) * 64 + 64
    padded = np.zeros(lanes, dtype="<u8")
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(planes: np.ndarray, shifts: np.ndarray, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row s, lane i) of ``wanted`` (a boolean per shift and lane) where lane i is within ``radius`` of lane i + shifts[s].

    The counters are bit-sliced too: counter c holds bit c of the number of differences so far of each lane. Words of lanes that
    have all left the radius are left out of all further planes.
    """
    words = planes.shape[1]
    alive = np.zeros((len(shifts), words * 8), dtype=np.uint8)
    packed = np.packbits(wanted, axis=1, bitorder="little")
    alive[:, :packed.shape[1]] = packed
    alive = alive.view("<u8").ravel()
    at = np.flatnonzero(alive)
    row, word = np.divmod(at, words)
    low = np.minimum(word + shifts[row] // 64, words - 1)
    high = np.minimum(low + 1, words - 1)
    turn = (shifts[row] % 64).astype(np.uint64)
    back, live = np.uint64(64) - turn, alive[at]
    depth = radius.bit_length()
    start = (1 << depth) - 1 - radius  # counting from here, a carry out of the last counter means more than radius
    counters = [np.full(len(at), ~np.uint64(0) if start >> c & 1 else 0, dtype="<u8") for c in range(depth)]
    for b in range(64):
        plane = planes[b]
        other = plane[low] >> turn | np.where(turn == 0, np.uint64(0), plane[high] << (back & np.uint64(63)))
        carry = (plane[word] ^ other) & live
        for c in range(depth):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        live = live & ~carry
        if b % 8 == 7:
            still = live != 0
            if not still.all():
                at, word, low, high, turn, back, live = (x[still] for x in (at, word, low, high, turn, back, live))
                counters = [c[still] for c in counters]
                if not len(at):
                    break
    found = np.zeros(len(alive), dtype="<u8")
    found[at] = live
    return np.nonzero(np.unpackbits(found.view(np.uint8), bitorder="little").reshape(len(shifts), -1)[:, :wanted.shape[1]])


def forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the label trees of the pairs (a, b) in place and return those pairs, (2, n), that did it: fewer than the lanes merged. A label is the
    smallest lane of its tree."""
    used = []
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        # every tree hooks itself to a smaller one by one pair
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        trees, chosen = np.unique(high, return_index=True)
        labels[trees] = low[chosen]
        used.append(np.stack([a[chosen], b[chosen]]))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up
    return np.concatenate(used, axis=1) if used else np.zeros((2, 0), dtype=np.int64)


def links_of(runs: np.ndarray, fps: np.ndarray, sides: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``radius`` that span the groups connected by all pairs within ``radius`` in the same run, fewer than the lanes. ``runs`` is
    sorted. Side 1 and side 2 of a run are compared with each other only, side 0 with itself."""
    ends: list[np.ndarray] = []
    keep = np.arange(len(fps))
    labels = np.arange(len(fps))
    shift, planes = 1, bit_planes(fps)
    while len(keep) > shift:
        r, s, lab = runs[keep], sides[keep], labels[keep]
        shifts = np.arange(shift, min(2 * shift, shift + SHIFTS_AT_ONCE, len(keep)))
        todo = np.zeros((len(shifts), len(keep)), dtype=bool)
        for row, d in enumerate(shifts):
            todo[row, :-d] = (r[:-d] == r[d:]) & ((s[:-d] == 0) | (s[:-d] != s[d:])) & (lab[:-d] != lab[d:])
        if todo.any():
            row, lane = within(planes, shifts, todo, radius)
            ends.append(forest(labels, keep[lane], keep[lane + shifts[row]]))
        shift = int(shifts[-1]) + 1
        if len(keep) <= shift:
            break
        longer = r[:-shift] == r[shift:]
        if not longer.any():
            break
        if longer.sum() * 2 < len(keep) and len(keep) > 4096:  # most runs are over: lay out the rest anew
            keep = keep[np.isin(r, r[:-shift][longer])]
            planes = bit_planes(fps[keep])
    pairs = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), dtype=np.int64)
    return fps[pairs[0]], fps[pairs[1]]


def _compare(radius: int, rows_at_once: int):
    """Over rows sorted by bucket: collect whole buckets up to ``rows_at_once`` rows, then compare them together."""
    def flush(parts: list[pd.DataFrame]) -> tuple[list[pd.DataFrame], pd.DataFrame]:
        rows = pd.concat(parts, ignore_index=True)
        new = (rows[["t", "k", "i", "j"]] != rows[["t", "k", "i", "j"]].shift()).any(axis=1)
        runs = new.cumsum().to_numpy()
        last = runs == runs[-1]
        return [rows[last]], rows[~last].assign(run=runs[~last])

    def links(rows: pd.DataFrame, runs: np.ndarray) -> pd.DataFrame:
        a, b = links_of(runs, rows["fp"].to_numpy().view(np.uint64), rows["side"].to_numpy(), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for batch in batches:
            if len(batch):
                parts.append(batch)
                held += len(batch)
            if held >= rows_at_once:
                parts, done = flush(parts)
                held = len(parts[0])
                if len(done):
                    yield links(done, done["run"].to_numpy())
        if parts:
            parts, done = flush(parts)
            if len(done):
                yield links(done, done["run"].to_numpy())
            yield links(parts[0], np.ones(len(parts[0]), dtype=np.int64))
    return run


def near_links(fps: DataFrame, radius: int = 3, masks: Sequence[int] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(a, b): pairs within ``radius`` of distinct fingerprints of column ``fp`` that agree under one of ``masks``.

    Of the pairs that meet under a mask a spanning set is returned, so with ``block_masks`` for the radius (the default, five
    blocks for three bits) the transitive closure is that of all pairs.
    """
    masks = masks or block_masks(radius, radius + 2)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k"))
                       for t, m in enumerate(signed)])
    keyed = fps.select("fp", F.inline(tables))
    counts = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    chunks = F.ceil(F.col("__n") / chunk_rows).cast("int")
    # chunk c of a bucket meets every other chunk x in the task (min, max), and itself in (c, c)
    met = keyed.join(counts, ["t", "k"]).withColumn("__c", F.pmod(F.xxhash64("fp"), chunks).cast("int")).select(
        "t", "k", "fp", "__c", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("__x"))
    met = met.select("t", "k", F.least("__c", "__x").alias("i"), F.greatest("__c", "__x").alias("j"),
                     F.when(F.col("__c") == F.col("__x"), 0).when(F.col("__c") < F.col("__x"), 1).otherwise(2).alias("side"), "fp")
    return met.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", F.xxhash64("t", "fp")).mapInPandas(
        _compare(radius, 4 * chunk_rows), "a long, b long")


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def group(fps: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id of the component of each row's fingerprint."""
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b"))).distinct()
    groups = store(connected_components(nodes, links).select(F.col("node").alias("fp"), "component"))
    rooted = store(fps.join(groups, "fp", "left").select("doc_id", "fp", F.coalesce("component", "fp").alias("root")))
    least = store(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")))  # both stored, so that the joins can split a hot key
    return rooted.join(least, "root").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links between
    fingerprints with at most ``radius`` differing bits).

    Words are runs of characters other than white space with A-Z lowered, shingles ``width`` of them; a shorter text is one shingle,
    a null or empty one has fingerprint zero and links like any other. Rows without doc_id link others, and get the component's
    doc_id, null if it has none. Other columns are not read. An empty table gives an empty result.
    """
    fps = store(fingerprints(docs, width))
    links = store(near_links(store(fps.select("fp").distinct()), radius).distinct())
    return group(fps, links).select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def similarity(a: str | None, b: str | None, width: int) -> float:
    """Share of common distinct shingles."""
    own, other = set(shingle_hashes(a, width)), set(shingle_hashes(b, width))
    return len(own & other) / len(own | other) if own or other else 1.0


def in_order(hashes: Sequence[int], common: np.ndarray) -> np.ndarray:
    """The distinct hashes in 63 bits as signed longs, in the one order of all prefixes: by number, those of ``common`` (sorted, not negative) last."""
    own = (np.unique(np.array(hashes, dtype="<u8")) >> np.uint64(1)).view(np.int64)
    if len(common):
        last = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
    else:
        last = np.zeros(len(own), dtype=bool)
    return np.sort(np.where(last, own, own + np.int64(-1 << 63)))


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """The shingles that most documents of a sample hold. They only go last in the order of prefixes, so the choice decides the work, not the result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            own = [np.unique(np.array(shingle_hashes(t, shingle), dtype="<u8")) >> np.uint64(1) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))], ["h"])
    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_IN)) == 0).mapInArrow(run, "h long")
    often = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON_IN_SAMPLE)
    return np.sort(np.array([r["h"] for r in often.orderBy(F.desc("n"), "h").limit(COMMON_MOST).collect()], dtype=np.int64))


def shingle_prefixes(docs: DataFrame, width: int, shingle: int, least: float) -> DataFrame:
    """Per row of ``docs``: doc_id, fp, ``th`` (hash of the text), and of the set of its ``shingle``-word shingles ``key`` (its hash, null if it is empty),
    ``size`` and ``prefix``: its first shingles, of which sets that share ``least`` have one in common."""
    common = common_shingles(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = batch.column(1).to_pylist()
            fps = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
            sets = [in_order(shingle_hashes(t, shingle), common) for t in texts]
            keys = [xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None for own in sets]
            heads = [own[:len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1] if len(own) else own for own in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps.view(np.int64)), batch.column(2), pa.array(keys, pa.int64()), pa.array([len(own) for own in sets], pa.int64()),
                 pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "fp", "th", "key", "size", "prefix"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).mapInArrow(
        run, "doc_id long, fp long, th long, key long, size long, prefix array<long>")


def promising(met: DataFrame, least: float) -> DataFrame:
    """(a, b, spot) of the pairs (one row a common prefix shingle ``h``; keys, sizes and last prefix shingles of both) that may share ``least``. All of
    the prefix that ends first is counted against the other, so beyond the count only the rest of that set can be common."""
    small, large = F.least("sa", "sb"), F.greatest("sa", "sb")
    first = F.when(F.col("la") <= F.col("lb"), F.col("sa")).otherwise(F.col("sb"))
    most = F.col("n") + F.ceil(F.lit(least) * first - 1e-9) - 1
    fits = met.filter((F.col("a") != F.col("b")) & (small >= F.lit(least) * large - 1e-6))
    return fits.groupBy("a", "b", "sa", "sb", "la", "lb").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("spot")).filter(
        most >= F.lit(least / (1 + least)) * (F.col("sa") + F.col("sb")) - 1e-6).select("a", "b", "sa", "sb", "spot")


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, shingle: int, least: float, block_sets: int = BLOCK_SETS,
             block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b): of ``pairs`` (a, b, sa, sb, spot) those that share ``least`` on reading, as far as they join what was apart in their block.

    The sets of a spot are cut into chunks of bounded size; a block holds the texts of two chunks, each read once however many pairs it is in.
    """
    pairs = store(pairs)
    ends = pairs.select("spot", F.inline(F.array(F.struct(F.col("a").alias("key"), F.col("sa").alias("size")), F.struct(F.col("b").alias("key"), F.col("sb").alias("size"))))).distinct()
    spots = store(ends.groupBy("spot").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("size") / block_shingles)).alias("chunks")))
    one, two = (F.pmod(F.xxhash64(F.col(c), F.lit(5)), F.col("chunks")).cast("int") for c in "ab")
    placed = store(pairs.join(spots, "spot").select("spot", "a", "b", F.least(one, two).alias("i"), F.greatest(one, two).alias("j")))
    needed = store(placed.select("spot", "i", "j", F.explode(F.array("a", "b")).alias("key")).distinct().join(sets.select("key", "th"), "key"))
    # a bitmap of bounded size first keeps most other texts out of the shuffle
    bit = F.pmod("th", F.lit(NEEDED_BITS))
    word, flag = F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(th, {NEEDED_BITS}) & 63 as int))")
    bitmap = needed.groupBy(word).agg(F.bit_or(flag).alias("flags"))
    some = docs.select("text", F.xxhash64("text").alias("th")).withColumn("word", word).join(F.broadcast(bitmap), "word").filter(
        F.col("flags").bitwiseAND(flag) != 0).select("text", "th")
    once = some.join(needed.select("th").distinct(), "th", "left_semi").groupBy("th").agg(F.min("text").alias("text"))
    texts = needed.join(once, "th").groupBy("spot", "i", "j").agg(F.collect_list(F.struct("key", "text")).alias("texts"))
    blocks = placed.groupBy("spot", "i", "j").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")).join(texts, ["spot", "i", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            for a, b, texts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                own = {t["key"]: np.unique(np.array(shingle_hashes(t["text"], shingle), dtype="<u8")) for t in texts}
                place = {key: n for n, key in enumerate(own)}
                labels, links = list(range(len(own))), []

                def root(x: int) -> int:
                    while labels[x] != x:
                        labels[x] = x = labels[labels[x]]
                    return x

                for x, y in zip(a, b):
                    rx, ry = root(place[x]), root(place[y])
                    if rx != ry:
                        both = len(np.intersect1d(own[x], own[y], assume_unique=True))
                        if both / (len(own[x]) + len(own[y]) - both) >= least:
                            labels[rx] = ry
                            links.append((x, y))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])
    return blocks.select("a", "b", "texts").mapInArrow(run, "a long, b long")


def similar_links(docs: DataFrame, rows: DataFrame, close: DataFrame, shingle: int, least: float, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(a, b): links of fingerprints that, with ``close``, connect the rows whose texts share at least ``least`` of their shingles.

    An exact join: sets that share so much have a shingle of their prefixes in common. Sets first meet one hub of each bucket; then all pairs
    of a bucket that are not connected yet by verified links meet, over salts, and every one that can share enough is read.
    """
    sets = store(rows.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("fp").alias("fp"), F.min("th").alias("th"), F.first("size").alias("size"), F.first("prefix").alias("prefix")))
    equal = rows.select("key", F.col("fp").alias("b")).distinct().join(sets.select("key", F.col("fp").alias("a")), "key").filter("a != b").select("a", "b")
    entries = sets.select("key", "size", F.element_at("prefix", -1).alias("last"), F.explode("prefix").alias("h"))
    bucket = Window.partitionBy("h")
    shared = store(entries.withColumns({
        "n": F.count(F.lit(1)).over(bucket),
        "hub": F.min(F.struct(F.xxhash64("key").alias("o"), "key", "size", "last")).over(bucket)}).filter(F.col("n") > 1))
    keys = sets.select("key", "fp")

    def of_fingerprints(found: DataFrame) -> DataFrame:
        return found.join(keys.select(F.col("key").alias("a"), F.col("fp").alias("fa")), "a").join(
            keys.select(F.col("key").alias("b"), F.col("fp").alias("fb")), "b").filter("fa != fb").select(F.col("fa").alias("a"), F.col("fb").alias("b"))

    def labelled(links: DataFrame) -> DataFrame:
        nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        groups = connected_components(nodes, links).select(F.col("node").alias("fp"), "component")
        return store(keys.join(groups, "fp", "left").select("key", F.coalesce("component", "fp").alias("label")))

    links = store(close.union(equal).distinct())
    label = labelled(links)
    hubs = promising(shared.select(F.col("hub.key").alias("a"), F.col("key").alias("b"), F.col("hub.size").alias("sa"), F.col("size").alias("sb"),
                                   F.col("hub.last").alias("la"), F.col("last").alias("lb"), "h"), least)
    apart = hubs.join(label.toDF("a", "ga"), "a").join(label.toDF("b", "gb"), "b").filter("ga != gb").drop("ga", "gb")
    links = store(links.union(of_fingerprints(verified(docs, sets, apart, shingle, least))).distinct())
    label = labelled(links)

    members = store(shared.drop("hub").join(label, "key"))
    mixed = store(members.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count(F.lit(1)) / salt_rows).cast("int").alias("salts")).filter(
        "lo != hi").select("h", "salts"))
    open_ = members.join(mixed, "h").drop("n")
    left = open_.withColumn("salt", F.pmod(F.xxhash64("key", "h"), F.col("salts")).cast("int")).select(
        "h", "salt", F.col("key").alias("a"), F.col("size").alias("sa"), F.col("last").alias("la"), F.col("label").alias("ga"))
    right = open_.select("h", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("key").alias("b"), F.col("size").alias("sb"),
                         F.col("last").alias("lb"), F.col("label").alias("gb"))
    met = left.join(right.hint("merge"), ["h", "salt"]).filter("a < b and ga != gb").drop("salt", "ga", "gb")
    return links.union(of_fingerprints(verified(docs, sets, promising(met, least), shingle, least))).distinct()


def similar_documents(docs: DataFrame, width: int = 3, radius: int = 3, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Near duplicates as in ``near_duplicates``, and also all documents that share at least ``least`` of their distinct ``shingle``-word shingles,
    however many bits apart. Returns doc_id, component_id; the same cases are defined alike."""
    rows = store(shingle_prefixes(docs, width, shingle, least))
    close = store(near_links(store(rows.select("fp").distinct()), radius).distinct())
    links = store(similar_links(docs, rows, close, shingle, least))
    return group(rows.select("doc_id", "fp"), links).select("doc_id", "component_id")
