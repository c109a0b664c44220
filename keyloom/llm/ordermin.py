"""Order MinHash fingerprints, in DataFrame functions only.

A text is its words; its features are runs of words numbered by occurrence, so that a repeated run counts each time. A feature has one
36-bit hash, and sketch j ranks features by that hash rotated to start at j / sketches of the range. Each sketch takes
the ``picks`` smallest, puts them back in text order and hashes the tuple of their runs: two texts share a value when they hold
the same runs in the same order, which edits and moves both disturb.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import range_chunks
from .common import SPACE_CLASS, SPACES, store

#: Sorting keys hold a hash of so many bits above the position in the text.
HASH_BITS, PLACE_BITS = 36, 27
_PLACES = (1 << PLACE_BITS) - 1


def _hash(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - HASH_BITS)


def _packed(h: Column, place: Column) -> Column:
    return F.shiftleft(h, PLACE_BITS).bitwiseOR(place)


def _high(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACES).cast("long"))


def add_fingerprint(df: DataFrame, text: str, name: str, width: int = 3, picks: int = 2, sketch_bits: int = 5) -> DataFrame:
    """Add ``name``: an array of 2 ** ``sketch_bits`` longs, a function of the text alone.

    Null counts as empty; a text with fewer words than ``width`` has one run of all its words (none at all: the empty run), and a
    sketch with fewer than ``picks`` features to choose from takes them all. No text is too long: everything is linear in
    its words but for the sorts of numbers.
    """
    sketches, space = 1 << sketch_bits, F.lit(SPACES)
    words = F.split(F.btrim(F.coalesce(F.col(text), F.lit("")), space), f"[{SPACE_CLASS}]+")
    step = df.withColumn("__w", F.transform(words, lambda w: F.xxhash64(w)))
    whole = F.slice(F.col("__w"), F.lit(1), F.greatest(F.size("__w") - (width - 1), F.lit(1)))
    # places past the end give null, which the hash passes over
    runs = F.transform(whole, lambda h, i: _packed(_hash(h, *[F.get(F.col("__w"), i + d) for d in range(1, width)]), i))
    step = step.withColumn("__r", F.sort_array(runs)).drop("__w")
    # the first of equal runs is a feature as it is; the others, numbered from 1 in text order, are hashed with their number
    above = lambda i: F.get(F.col("__r"), i - 1)
    step = step.withColumn("__once", F.filter("__r", lambda x, i: (i == 0) | (_high(x) != _high(above(i)))))
    step = step.withColumn("__more", F.when(F.size("__once") < F.size("__r"), F.filter(
        "__r", lambda x, i: (i > 0) & (_high(x) == _high(above(i))))).otherwise(F.array().cast("array<bigint>")))
    step = step.withColumn("__starts", F.filter(F.transform("__more", lambda x, i: F.when(
        (i == 0) | (_high(x) != _high(F.get(F.col("__more"), i - 1))), i).otherwise(-1)), lambda i: i >= 0))
    numbered = F.flatten(F.transform("__starts", lambda at, s: F.transform(
        F.slice(F.col("__more"), at + 1, F.coalesce(F.get(F.col("__starts"), s + 1), F.size("__more")) - at),
        lambda x, i: _packed(_hash(_high(x), i + 1), _place(x)))))
    step = step.withColumn("__f", F.when(F.size("__more") == 0, F.col("__once")).otherwise(
        F.sort_array(F.concat("__once", numbered)))).drop("__r", "__once", "__more", "__starts")
    # sketch j starts at the first feature whose leading bits are j or more, or else at the first of all
    lead = lambda x: F.shiftright(x, HASH_BITS + PLACE_BITS - sketch_bits).cast("int")
    passes = F.filter(F.transform("__f", lambda x, i: F.when(
        (i == 0) | (lead(x) != lead(F.get(F.col("__f"), i - 1))), i).otherwise(-1)), lambda i: i >= 0)
    step = step.withColumn("__p", passes)
    step = step.withColumn("__o", F.when(F.size("__p") == sketches, F.col("__p")).otherwise(F.transform(
        F.sequence(F.lit(0), F.lit(sketches - 1)), lambda j: F.coalesce(
            F.get(F.filter("__p", lambda at: lead(F.get(F.col("__f"), at)) >= j), F.lit(0)), F.lit(0)))))
    rest = lambda at: F.size("__f") - at

    def value(at: Column) -> Column:
        tail = F.slice(F.col("__f"), at + 1, F.lit(picks))
        chosen = F.when(rest(at) >= picks, tail).otherwise(F.concat(tail, F.slice(
            F.col("__f"), F.lit(1), F.least(F.lit(picks) - rest(at), at))))
        by_place = F.sort_array(F.transform(chosen, lambda x: F.shiftleft(_place(x), HASH_BITS).bitwiseOR(_high(x))))
        return F.xxhash64(F.transform(by_place, lambda y: y.bitwiseAND(F.lit((1 << HASH_BITS) - 1))))

    return step.withColumn(name, F.transform("__o", value)).drop("__f", "__p", "__o")


def likeness(a: Column, b: Column) -> Column:
    """Share of the sketches with the same value; null if a side is missing."""
    equal = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda s, x: s + x) / F.size(a).cast("double")


def as_text(fingerprint: Column) -> Column:
    """16 hex digits for each sketch."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lower(F.lpad(F.hex(v), 16, "0"))), "")


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next smaller distinct doc_id, of the smallest one the largest. Null ids have no neighbour and are none."""
    ids = range_chunks(docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct(), [], [F.desc("doc_id")])
    inside = F.lead("doc_id").over(Window.partitionBy("__chunk").orderBy(F.desc("doc_id")))
    edges = ids.groupBy("__chunk").agg(F.max("doc_id").alias("__top"))
    tops = Window.partitionBy(F.lit(1)).orderBy("__chunk")
    after = edges.select(F.col("__chunk").alias("__c"), F.coalesce(
        F.lead("__top").over(tops), F.first("__top").over(tops.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__after"))
    return ids.withColumn("__next", inside).join(after, F.col("__chunk") == F.col("__c")).select(
        "doc_id", F.coalesce("__next", "__after").alias("next_id"))


def edit_fingerprints(docs: DataFrame, width: int = 3, picks: int = 2, sketch_bits: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    The edited text has its last floor(n / 3) of n code points replaced by the first as many (or all) of the next document's text, next
    in descending doc_id, the first after the last. Returns doc_id, n_chars, edited_text, fingerprint, edited_fingerprint (arrays),
    near_edited, near_next. Null texts are empty. Rows that share a doc_id have the same next document; if several rows have the next
    doc_id, their smallest text is taken. A row without doc_id, and the only document of a table, is its own next document.
    An empty table gives an empty result.
    """
    # a key without null: both joins below then read one and the same exchange of the texts and their fingerprints
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    base = add_fingerprint(docs.select(key.alias("__id"), F.coalesce("text", F.lit("")).alias("text")), "text", "fingerprint",
                           width, picks, sketch_bits)
    ids = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).alias("n")))
    needed = ids.groupBy("doc_id").agg(F.max("n").alias("__n")).join(neighbours(ids), "doc_id").select(
        F.col("next_id").alias("__of"), F.col("doc_id").alias("__for"), F.floor(F.col("__n") / 3).cast("int").alias("__take"))
    heads = base.join(needed, F.col("__id") == F.col("__of")).groupBy("__for").agg(F.min(F.struct(
        F.substring("text", F.lit(1), F.col("__take")).alias("head"), F.col("fingerprint"))).alias("__next"))
    both = base.join(heads, F.col("__id") == F.col("__for"), "left").withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("doc_id", F.when(F.col("__id") != -(1 << 63), F.col("__id")))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    head = F.coalesce(F.col("__next.head"), F.col("text"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring(head, F.lit(1), cut))
    both = both.select("doc_id", "n_chars", "fingerprint", edited.alias("edited_text"),
                       F.coalesce(F.col("__next.fingerprint"), F.col("fingerprint")).alias("__other"))
    both = add_fingerprint(both, "edited_text", "edited_fingerprint", width, picks, sketch_bits)
    return both.select("doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("__other")).alias("near_next"))
