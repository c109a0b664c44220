"""Main text of web pages by a suffix array over the pages of a host.

Pages are cut into blocks of text. The token streams of a host's pages are laid end to end and their suffixes sorted; suffixes
of different pages that agree on long prefixes are passages the site repeats. Tokens they cover are removed outside a page's
article, what stands in elements made for menus, notices and the like goes by its markup, and the unique rest stays.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, store

#: A repeated passage has at least so many tokens (a power of two), or is a whole block.
RUN_TOKENS = 8
#: Pages of one suffix array. A larger host is cut, and its repeated passages are counted over all its pages before.
SHARD_PAGES = 512
#: Hosts with at least one in so many pages are dealt over tasks.
HOT_SHARE = 1000

# Elements and words of HTML.
RAW = frozenset("script style noscript template textarea iframe svg math object title select canvas video audio".split())
TEXT_ONLY = frozenset("script style textarea title".split())  # nothing but their end tag ends them
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav header footer aside form head menu dialog button fieldset".split())
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav aside form "
                   "blockquote pre figure figcaption address hr body html head details summary menu dialog fieldset legend center".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_EARLY = frozenset("p li dt dd tr td th".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup "
    "modal overlay newsletter subscribe subscription sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments "
    "disqus reply replies respond discussion social share sharing related recommended recommendations widget toolbar pagination pager login signup search "
    "form complementary contentinfo".split())
SURE_WORDS = frozenset("comment comments disqus reply replies respond discussion cookie cookies consent gdpr".split())
CONTENT_WORDS = frozenset("content container wrapper wrap main entry body text layout story".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: Up to the end of a tag: quotes count after an equals sign alone, so apostrophes elsewhere hide nothing. Nothing is tried twice.
ATTRIBUTES = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z0-9]+")

OUTSIDE, ARTICLE, DROPPED = 0, 1, 2


def names_in(attributes: str) -> set[str]:
    return {w for m in NAMED.finditer(attributes) for w in WORD.findall((m[1] or m[2] or m[3] or "").lower())}


def is_furniture(tag: str, attributes: str) -> bool:
    if tag in FURNITURE:
        return True
    if not attributes or tag in ("html", "body", "main") or tag in HEADINGS:
        return False
    return bool(names_in(attributes) & ({"comment", "comments"} if tag == "article" else FURNITURE_WORDS))


def furniture_share(tag: str, attributes: str) -> float:
    """The share of the text that such an element may hold and still be furniture."""
    names = names_in(attributes)
    if names & SURE_WORDS or tag in FURNITURE and tag != "form":
        return 1.0
    return 0.5 if names & CONTENT_WORDS else 0.9 if tag == "form" else 1.0


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of the tags in order, without name for comments and raw elements. The scan moves forward only: what one tag
    finds missing in the rest of the page (an end of a tag, an end tag) is not looked for again."""
    at, quotes, ends = 0, True, {}
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        opened = TAG.match(page, start)
        if not opened and page[at:at + 1] not in ("!", "?"):
            continue
        found = ATTRIBUTES.match(page, opened.end()) if opened and quotes else None
        if not found:
            quotes = quotes and not opened
            end = page.find(">", at)
            if end < 0:
                return
            at = end + 1
            attributes = page[opened.end():end] if opened else ""
        else:
            at, attributes = found.end(), found[1]
        name, closing = (opened[2].lower(), bool(opened[1])) if opened else ("", False)
        if name in RAW and not closing and not (attributes.endswith("/") and name not in TEXT_ONLY):
            if name not in ends:
                ends[name] = [m.span() for m in re.finditer(rf"</{name}(?=[\s/>])[^>]*+>?", page, re.I)]
            last = bisect_left(ends[name], (at, 0))
            if last < len(ends[name]):
                at = ends[name][last][1]
            elif name in TEXT_ONLY:
                at = len(page)
            name = ""
        yield start, at, name, closing, attributes


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page in order: in the article or main element, in furniture, or elsewhere. White space in a
    block is one space, character references are decoded, empty blocks are left out. An element that looks like furniture, but by its names
    may be the content too, is none if it holds most of the text of the page, or of its article if there is one; nor is a form that holds nine
    tenths. Up to eight such elements may stand one in the other."""
    tags, stands = list(tags_of(page or "")), set()
    for _ in range(9):
        found = cut(page or "", tags, stands)
        sizes, held = [0, 0], Counter()
        for kind, text, inside, part in found:
            sizes[inside] += len(text)
            if kind == DROPPED:
                held[part, inside] += len(text)
        whole = sizes[1] or sizes[0]
        wrong = {part[0] for (part, inside), n in held.items() if inside == bool(sizes[1]) and n > part[1] * whole}
        if not wrong:
            break
        stands |= wrong
    return [(kind, text) for kind, text, _, _ in found]


def cut(page: str, tags: list[tuple[int, int, str, bool, str]], stands: set[int]) -> list[tuple[int, str, bool, tuple[int, float]]]:
    """(kind, text, whether in an article or main element, (start of the furniture, share of the text up to which it is)) of each block; elements
    that start at ``stands`` are no furniture."""
    out: list[tuple[int, str, bool, tuple[int, float]]] = []
    buffer: list[str] = []
    main, skip, depth, at, part = 0, "", 0, 0, (0, 1.0)

    def flush() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((DROPPED if skip else ARTICLE if main else OUTSIDE, text, main > 0, part))

    for start, end, tag, closing, attributes in tags:
        if start > at:
            buffer.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            buffer.append(" ")
        if tag in BLOCKS:
            flush()
        if skip:
            if tag == skip and tag not in VOID:
                depth += -1 if closing else 0 if tag in ENDS_EARLY else 1
            over = depth <= 0 or not closing and (tag in MAIN and skip != "article" or skip in ENDS_EARLY and tag in BLOCKS)
            if not over or closing:
                skip = "" if over else skip
                continue
            flush()
            skip = ""
        if not closing and tag not in VOID and start not in stands and is_furniture(tag, attributes):
            flush()
            skip, depth, part = tag, 1, (start, furniture_share(tag, attributes))
        elif tag in MAIN:
            main = max(0, main + (-1 if closing else 1))
    buffer.append(page[at:])
    flush()
    return out


def repeated(tokens: np.ndarray, pages: np.ndarray, starts: np.ndarray, lengths: np.ndarray, min_pages: int) -> np.ndarray:
    """Which tokens lie in a passage of ``RUN_TOKENS`` tokens, or in a whole shorter block, that at least ``min_pages`` pages hold.

    Suffixes are sorted by their first ``RUN_TOKENS`` tokens by prefix doubling; longer repeats are unions of such
    passages. ``tokens`` has each block followed by ``RUN_TOKENS`` - 1 fillers (-1), ``starts`` and ``lengths`` tell where blocks are.
    """
    covered = np.zeros(len(tokens), dtype=bool)
    rank, step = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while step < RUN_TOKENS:
        ahead = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])
        rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        step *= 2
    block = np.repeat(np.arange(len(starts)), lengths)
    inside = np.arange(len(block)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = lengths[block] - inside
    valid = (left >= RUN_TOKENS) | (inside == 0)
    places, left = starts[block][valid] + inside[valid], np.minimum(left[valid], RUN_TOKENS)
    suffixes = np.lexsort((pages[places], rank[places]))
    r, p = rank[places][suffixes], pages[places][suffixes]
    head = np.concatenate([[True], r[1:] != r[:-1]])
    page_head = head | np.concatenate([[True], p[1:] != p[:-1]])
    group = np.cumsum(head) - 1
    often = np.bincount(group[page_head])[group] >= min_pages
    hits, reach = places[suffixes][often], left[suffixes][often]
    edge = np.zeros(len(tokens) + 1, dtype=np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + reach, -1)
    covered[:] = np.cumsum(edge[:-1]) > 0
    return covered


def passages(text: str) -> list[int]:
    """Hashes of the passages that start at each token of a block: ``RUN_TOKENS`` tokens, or a whole shorter block."""
    words = text.split(" ")
    if len(words) < RUN_TOKENS:
        return [xxhash.xxh64_intdigest(text + "\n") - (1 << 63)]
    return [xxhash.xxh64_intdigest(" ".join(words[i:i + RUN_TOKENS])) - (1 << 63) for i in range(len(words) - RUN_TOKENS + 1)]


def covered_by(text: str, common: np.ndarray) -> np.ndarray:
    """Which tokens of a block lie in a passage of ``common``."""
    edge = np.zeros(text.count(" ") + 2, dtype=np.int64)
    hits = np.flatnonzero(np.isin(np.array(passages(text), dtype=np.int64), common))
    np.add.at(edge, hits, 1)
    np.add.at(edge, np.minimum(hits + RUN_TOKENS, len(edge) - 1), -1)
    return np.cumsum(edge[:-1]) > 0


def main_texts(rows: pd.DataFrame, min_pages: int, share: float, common: np.ndarray | None = None) -> list[str]:
    """Main text of each page (columns kinds and texts) of one host, or of some of its pages if ``common`` holds the host's repeated passages."""
    words, page_of, starts, lengths, where = [], [], [], [], []
    at = 0
    for page, texts in enumerate(rows["texts"]):
        for b, text in enumerate(texts):
            own = text.split(" ")
            words.extend(own)
            starts.append(at), lengths.append(len(own)), where.append((page, b))
            at += len(own) + RUN_TOKENS - 1
    covered = np.zeros(0, dtype=bool)
    if where and common is None:
        starts, lengths = np.array(starts), np.array(lengths)
        tokens = np.full(at, -1, dtype=np.int64)
        tokens[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(words))] = pd.factorize(np.array(words, dtype=object))[0]
        page_of = np.repeat(np.array([w[0] for w in where]), lengths + RUN_TOKENS - 1)
        covered = repeated(tokens, page_of, starts, lengths, max(min_pages, int(np.ceil(share * len(rows)))))
    kept: list[list[str]] = [[] for _ in range(len(rows))]
    kinds, texts = rows["kinds"].tolist(), rows["texts"].tolist()
    has_main = [ARTICLE in k for k in kinds]
    for (page, b), start, length in zip(where, starts, lengths):
        kind = kinds[page][b]
        if kind == DROPPED or kind == OUTSIDE and has_main[page]:
            continue
        text = texts[page][b]
        if kind == OUTSIDE:
            own = covered[start:start + length] if common is None else covered_by(text, common)
            text = " ".join(w for w, gone in zip(text.split(" "), own) if not gone) if own.any() else text
        if text:
            kept[page].append(text)
    return ["\n".join(k) for k in kept]


def main_text(pages: DataFrame, min_pages: int = 3, share: float = 0.01, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """page_id, url, text for each row of ``pages``.

    Text is the page's blocks joined by newlines. Blocks in furniture (menus, headers, footers, sidebars, notices, adverts,
    forms, reader comments, known by element or by class, id or role) go. If the page has an article or main element its blocks
    are the text; else what is left of the others after passages that at least ``min_pages`` pages, and ``share`` of the
    pages, of its host repeat. The host is the part of the url after :// (null or none: the empty host). Of hosts with more than
    ``shard_pages`` pages, passages are counted by a Spark aggregate if any of their pages needs them. Null and empty html give the empty text; rows that
    repeat each give a row; pages are scanned forwards only, whatever tags and quotes they leave open. An empty table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host.alias("__host"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [blocks_of(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array([[k for k, _ in f] for f in found], pa.list_(pa.int32())),
                 pa.array([[t for _, t in f] for f in found], pa.list_(pa.string()))], ["page_id", "url", "host", "kinds", "texts"])

    def passages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            for host_, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.array(list({h for _, t in blocks_of(source) for h in passages(t)}), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([host_] * len(own), pa.string()), pa.array(own)], ["__host", "h"])

    def needing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            kinds = [[k for k, _ in blocks_of(source)] for source in batch.column(1).to_pylist()]
            found = {h for h, own in zip(batch.column(0).to_pylist(), kinds) if OUTSIDE in own and ARTICLE not in own}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["__host"])

    parsed = plain.mapInArrow(parse, "page_id long, url string, host string, kinds array<int>, texts array<string>")
    counts = plain.groupBy("__host").agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    # at most HOT_SHARE hosts can hold 1 / HOT_SHARE of the pages, so this side is bounded whatever the number of hosts
    hot = counts.filter((F.col("__n") > shard_pages) & (F.col("__n") * HOT_SHARE >= total))
    shards = F.coalesce(F.ceil(F.col("__n") / shard_pages), F.lit(1))
    dealt = parsed.join(F.broadcast(hot), F.col("host") == F.col("__host"), "left").withColumn("turn", F.xxhash64("page_id", "url"))
    dealt = dealt.withColumn("shard", F.pmod("turn", shards).cast("int")).select("page_id", "url", "host", "shard", "turn", "kinds", "texts")

    # hosts that one suffix array does not hold: their passages that pages share, where a page without article or main needs them
    large = store(counts.filter(F.col("__n") > shard_pages))
    of_large = plain.join(large, "__host").select("__host", "html")
    wanted = store(of_large.mapInArrow(needing, "__host string").distinct())
    often = of_large.join(wanted, "__host", "left_semi").mapInArrow(passages_of, "__host string, h long").groupBy("__host", "h").agg(
        F.count(F.lit(1)).alias("__pages")).join(large, "__host").filter(
        F.col("__pages") >= F.greatest(F.lit(min_pages), F.ceil(F.lit(share) * F.col("__n"))))
    lists = large.join(often.groupBy("__host").agg(F.collect_list("h").alias("common")), "__host", "left")
    is_hot = F.col("__n") * HOT_SHARE >= F.lit(total)
    # one row ahead of each shard of such a host
    ahead = lists.select(F.col("__host").alias("host"), F.explode(F.sequence(F.lit(0), F.when(is_hot, F.ceil(F.col("__n") / shard_pages) - 1).otherwise(0).cast("int"))).alias("shard"),
                         F.coalesce("common", F.array().cast("array<long>")).alias("common"))
    dealt = dealt.withColumn("common", F.lit(None).cast("array<long>")).unionByName(ahead, allowMissingColumns=True)

    def extract(rows: list[pd.DataFrame], common: np.ndarray | None) -> pd.DataFrame:
        own = pd.concat(rows, ignore_index=True)
        return own[["page_id", "url"]].assign(text=main_texts(own, min_pages, share, common)).astype({"page_id": "Int64"})

    def shard_by_shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key, common = [], None, None
        for batch in batches:
            for own, rows in batch.groupby(["host", "shard"], sort=False):
                if own != key:
                    if held:
                        yield extract(held, common)
                    held, common = [], None
                key = own
                first = rows["common"].iloc[0]
                if first is not None:  # the shard's row ahead comes first
                    common, rows = np.asarray(first, dtype=np.int64), rows.iloc[1:]
                while len(rows):
                    room = shard_pages - sum(map(len, held))
                    held.append(rows.iloc[:room])
                    rows = rows.iloc[room:]
                    if sum(map(len, held)) == shard_pages:
                        yield extract(held, common)
                        held = []
        if held:
            yield extract(held, common)

    return dealt.repartition("host", "shard").sortWithinPartitions("host", "shard", F.col("common").isNull(), "turn").mapInPandas(
        shard_by_shard, "page_id long, url string, text string")
