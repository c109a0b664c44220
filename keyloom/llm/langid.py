"""Language identification with interpolated Kneser-Ney character models.

One model per language, trained on a bounded, hash-chosen sample of whole labelled documents. The models of all languages share
sorted arrays of n-gram hashes: a row of log-probabilities (one per language) for each n-gram and of back-off weights for
each context. A text gets the language with the lowest cross-entropy per character, and is rejected if
that is above what held-out training documents of the language show.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
ORDER = 4
#: Labelled documents per language that the models are trained on, whole texts; a quarter of them calibrates.
SAMPLE_DOCS = 400
SPACE = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def letters_of(points: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool))
    return _LETTERS[0][points]


def characters(text: str | None) -> np.ndarray:
    """Lower-case letters with one space for every run of anything else, a space at both ends; empty if there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = letters_of(points)
    if not letter.any():
        return np.zeros(0, dtype=np.uint64)
    points = np.where(letter, points, SPACE)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters stays
    inner = points[keep]
    inner = inner[1:] if inner[0] == SPACE else inner
    inner = inner[:-1] if inner[-1] == SPACE else inner
    return np.concatenate([[SPACE], inner, [SPACE]]).astype(np.uint64)


def gram_hashes(chars: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Entry k - 1: hash of the k characters that end at each position; spaces stand before the text."""
    hashes = [chars + np.uint64(1)]
    for _ in range(1, order):
        before = np.concatenate([[_pad(len(hashes))], hashes[-1][:-1]])
        hashes.append(before * _STEP + hashes[0])
    return hashes


def _pad(k: int) -> np.uint64:
    """Hash of k spaces."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for _ in range(k):
            h = h * _STEP + np.uint64(SPACE + 1)
    return h


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)       # per order: sorted hashes
    log_probs: list[np.ndarray] = field(default_factory=list)   # per order: a row per hash, a column per language
    contexts: list[np.ndarray] = field(default_factory=list)
    log_backoff: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None                            # log-probability of a character nobody has seen
    calibration: np.ndarray | None = None                       # per language: cross-entropy of texts and of shuffled texts, variance of a character

    def log_likelihood(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Per language: sum of log-probabilities and of their squares over the characters after the first; their number."""
        hashes = gram_hashes(chars)
        _, first, counts = np.unique(hashes[-1][1:], return_index=True, return_counts=True)
        each = self.log_probabilities(hashes, first + 1)
        return counts @ each, counts @ (each * each), int(counts.sum())

    def log_probabilities(self, hashes: list[np.ndarray], places: np.ndarray) -> np.ndarray:
        """Of the characters at ``places`` (not 0) after those before them: a row per place, a column per language."""
        out = np.zeros((len(places), len(self.languages)))
        left = np.arange(len(places))
        for k in range(ORDER, 0, -1):
            at, hit = _find(self.grams[k - 1], hashes[k - 1][places[left]])
            out[left[hit]] += self.log_probs[k - 1][at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            if k > 1:  # the context ends one position earlier
                at, hit = _find(self.contexts[k - 1], hashes[k - 2][places[left] - 1])
                out[left[hit]] += self.log_backoff[k - 1][at[hit]]
        out[left] += self.unseen
        return out


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def _hash_rows(chars: np.ndarray) -> np.ndarray:
    h = np.zeros(len(chars), dtype=np.uint64)
    for c in range(chars.shape[1]):
        h = h * _STEP + chars[:, c].astype(np.uint64) + np.uint64(1)
    return h


def fit(counts: pd.DataFrame) -> Model:
    """Kneser-Ney tables from (lang, c0 .. c3, n): how often each run of four characters occurs in each language.

    The highest order uses counts, lower ones the number of distinct characters before the n-gram. Each order takes one discount off,
    n1 / (n1 + 2 n2), and gives it to the next lower order; order 0 is uniform over the alphabet and one more.
    """
    languages = sorted(counts["lang"].unique())
    lang = counts["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy()
    chars = counts[[f"c{i}" for i in range(ORDER)]].to_numpy()
    n = counts["n"].to_numpy(dtype=np.float64)
    width = len(languages)
    levels = {}
    for k in range(ORDER, 0, -1):  # distinct n-grams of every order with their (continuation) counts
        gram, context = _hash_rows(chars), _hash_rows(chars[:, :-1])
        levels[k] = (chars, lang, n, gram, context)
        if k > 1:
            pairs = pd.DataFrame(chars[:, 1:]).assign(lang=lang).value_counts(sort=False).reset_index(name="n")
            chars, lang, n = pairs[list(range(k - 1))].to_numpy(), pairs["lang"].to_numpy(), pairs["n"].to_numpy(dtype=np.float64)
    model = Model(languages)
    lower_grams, lower = np.zeros(0, np.uint64), np.full((1, width), 1.0 / (len(np.unique(levels[1][0])) + 1))
    for k in range(1, ORDER + 1):
        chars, lang, n, gram, context = levels[k]
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = once / (once + 2 * twice) if once else 0.5
        contexts, which = np.unique(context, return_inverse=True)
        seen, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
        np.add.at(seen, (which, lang), n)
        np.add.at(kinds, (which, lang), 1.0)
        backoff = np.where(seen > 0, discount * kinds / np.maximum(seen, 1), 1.0)
        grams, first, row = np.unique(gram, return_index=True, return_inverse=True)
        own = np.zeros((len(grams), width))
        np.add.at(own, (row, lang), np.maximum(n - discount, 0.0))
        up = which[first]
        if k == 1:
            below = np.repeat(lower, len(grams), axis=0)
        else:
            below = lower[np.searchsorted(lower_grams, _hash_rows(chars[first][:, 1:]))]
        probs = own / np.maximum(seen[up], 1) + backoff[up] * below
        model.grams.append(grams), model.log_probs.append(np.log(probs))
        model.contexts.append(contexts), model.log_backoff.append(np.log(backoff))
        if k == 1:
            model.unseen = np.log(backoff[0] * lower[0])
        lower_grams, lower = grams, probs
    return model


def calibrate(model: Model, texts: pd.DataFrame) -> None:
    """From (lang, text) rows that the model has not been fitted to: per language the mean cross-entropy, that of the same texts with their
    characters shuffled (under the language that likes them best), and the variance of a character."""
    own: list[list[tuple[float, float, float]]] = [[] for _ in model.languages]
    shuffle = np.random.default_rng(0)
    for lang, text in texts.itertuples(index=False):
        chars = characters(text)
        if lang in model.languages and len(chars) > 20:
            i = model.languages.index(lang)
            total, squares, n = model.log_likelihood(chars)
            noise = np.concatenate([[SPACE], shuffle.permutation(chars[1:-1]), [SPACE]]).astype(np.uint64)
            own[i].append((-total[i] / n, -model.log_likelihood(noise)[0].max() / n, squares[i] / n - (total[i] / n) ** 2))
    everything = [r for rows in own for r in rows] or [(0.0, np.log(1e6), 0.0)]
    model.calibration = np.array([np.mean(rows if len(rows) >= 5 else everything, axis=0) for rows in own])


def predict(model: Model, text: str | None, strictness: float) -> tuple[str, float, float | None, bool]:
    """(language, score, cross-entropy, accepted). The score is the share of the language among the per-character likelihoods."""
    chars = characters(text)
    if not len(chars) or not model.languages:
        return UNKNOWN, 0.0, None, False
    total, _, n = model.log_likelihood(chars)
    entropy = -total / n
    best = int(np.argmin(entropy))
    mean, noise, each = model.calibration[best]
    limit = mean + (1 - strictness) * (noise - mean) + 3 * np.sqrt(each / n)
    return model.languages[best], float(1 / np.exp(entropy[best] - entropy).sum()), float(entropy[best]), bool(entropy[best] <= limit)


def train(docs: DataFrame, usable: Column, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on up to ``sample_docs`` documents per non-null language among the ``usable`` rows, chosen by a hash of doc_id."""
    labelled = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = labelled.groupBy(F.col("lang").alias("__lang")).agg(F.count(F.lit(1)).alias("__rows"))
    # both broadcasts hold less per language than the model does: a count, then up to sample_docs ids
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = labelled.select("lang", "doc_id").join(F.broadcast(counts), F.col("lang") == F.col("__lang")).filter(
        u * F.col("__rows") < 2 * sample_docs)  # about twice as many as needed, whatever the size of the language
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = few.select("lang", "doc_id").distinct().withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= sample_docs).select(
        F.col("lang").alias("__lang"), F.col("doc_id").alias("__id"), "__n")
    sample = docs.select("doc_id", "lang", "text").join(
        F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang"))).select("lang", "text", "__n")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f"c{i}" for i in range(ORDER)]
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                parts = [np.zeros((0, ORDER), np.int64)]
                for text in rows["text"]:
                    chars = characters(text).astype(np.int64)
                    if len(chars):
                        padded = np.concatenate([[SPACE] * (ORDER - 1), chars])
                        parts.append(np.stack([padded[i + 1:len(chars) + i] for i in range(ORDER)], axis=1))
                grams = pd.DataFrame(np.concatenate(parts), columns=names)
                yield grams.value_counts(sort=False).reset_index(name="n").assign(lang=lang)[["lang", *names, "n"]]

    kept = F.pmod(F.col("__n"), F.lit(4)) != 0
    grams = sample.filter(kept).select("lang", "text").mapInPandas(count, "lang string, c0 long, c1 long, c2 long, c3 long, n long")
    table = grams.groupBy("lang", *[f"c{i}" for i in range(ORDER)]).agg(F.sum("n").alias("n")).toPandas()  # bounded by the sample
    model = fit(table) if len(table) else Model([])
    calibrate(model, sample.filter(~kept).select("lang", "text").toPandas())
    return model


def identify(docs: DataFrame, usable: Column | None = None, sample_docs: int = SAMPLE_DOCS, strictness: float = 0.3) -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy and accepted; columns of these names are replaced.

    The model learns from ``text`` and ``lang`` of the ``usable`` rows (all by default) and predicts from ``text`` alone. A text
    that is null or has no letter is ``und`` with score 0 and is rejected; so is every text if there is nothing to learn from. A text is rejected
    too if its cross-entropy is closer than ``strictness`` (a share of the way) to that of held-out training documents with their characters shuffled
    than to theirs as they are, with three standard errors for its length. The default lets documents through that mix learned languages. Ties go to the first language by code point. Rows may repeat and doc_id may be null (such
    rows are not learned from). An empty table gives an empty result.
    """
    model = train(docs, F.lit(True) if usable is None else usable, sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("accepted", pa.bool_())])

    @F.arrow_udf("struct<lang_pred: string, score: double, cross_entropy: double, accepted: boolean>")
    def judge(texts: pa.Array) -> pa.Array:
        found = [predict(shared.value, t.as_py(), strictness) for t in texts]
        return pa.array([dict(zip(("lang_pred", "score", "cross_entropy", "accepted"), f)) for f in found], type=out)

    plain = docs.drop("lang_pred", "score", "cross_entropy", "accepted")
    return plain.withColumn("__judged", judge("text")).select(*plain.columns, "__judged.*")
