"""Enrichment of feature sets and ranked lists in attributes, pathways and ontology terms.

Annotations are long ``(attribute, key)`` tables, targets are long ``(set_id, key)`` tables, so many sets are tested in
one job. Counting is joins and combining aggregates; Python only sees one row per set and attribute.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats
from ..session import checkpoint, spread, stored
from .ranking import fdr_adjust, quantiles, row_numbers
from .skew import grid

SET = "set_id"

# --- tests on count parameters -------------------------------------------------------------------------------------


def _row_test(fn: Callable[[int, int, int, int], float]):
    """Arrow UDF over (population, draws, successes, hits) that solves each distinct parameter tuple once per batch."""
    @F.pandas_udf(T.DoubleType())
    def run(population: pd.Series, draws: pd.Series, successes: pd.Series, hits: pd.Series) -> pd.Series:
        frame = np.column_stack([population, draws, successes, hits]).astype(np.int64)
        distinct, back = np.unique(frame, axis=0, return_inverse=True)
        solved = np.array([fn(*map(int, row)) for row in distinct], dtype=float)
        return pd.Series(solved[back.reshape(-1)])
    return run


def permutation_test(reps: int, seed: int = 0) -> Callable[[int, int, int, int], float]:
    """(hits + 1) / (reps + 1) over random draws of the set.

    Each draw reaches the observed count with the hypergeometric tail probability, independently of the others, so
    the number of draws that do is binomial; that number is drawn directly instead of the sets.
    """
    def run(population: int, draws: int, successes: int, hits: int) -> float:
        if draws == 0:
            return math.nan
        if hits * population >= successes * draws and hits > 0:
            tail = stats.hypergeom_sf(hits - 1, population, successes, draws)
        else:
            tail = stats.hypergeom_cdf(hits, population, successes, draws)
        rng = np.random.default_rng([seed, population, draws, successes, hits])
        return (rng.binomial(reps, min(max(tail, 0.0), 1.0)) + 1) / (reps + 1)
    return run


COUNT_TESTS: dict[str, Callable[[int, int, int, int], float]] = {
    "fisher": stats.fisher_pvalue,
    "hypergeometric": stats.hypergeometric_pvalue,
}


def register_test(name: str, fn: Callable[[int, int, int, int], float]) -> None:
    """Add a test that maps (population, draws, successes, hits) to a p-value."""
    COUNT_TESTS[name] = fn


def _test(name: str, reps: int = 10000, seed: int = 0) -> Callable[[int, int, int, int], float]:
    if name in ("randomization", "permutation"):
        return permutation_test(reps, seed)
    if name not in COUNT_TESTS:
        raise ValueError(f"unknown statistical test {name!r}")
    return COUNT_TESTS[name]


# --- scope ------------------------------------------------------------------------------------------------------------

def resolve_background(annotations: DataFrame, key: str, background: DataFrame | None = None,
                       exclude_unannotated: bool = True, annotated: DataFrame | None = None) -> DataFrame:
    """Background keys: all annotated ones, or the given ones (limited to annotated unless told otherwise).

    A wide reference table also lists features without any attribute; pass its keys as ``annotated`` to count them."""
    annotated = (annotations if annotated is None else annotated).select(key).filter(F.col(key).isNotNull()).distinct()
    if background is None:
        return annotated
    given = background.select(key).filter(F.col(key).isNotNull()).distinct()
    return given.join(annotated, key, "left_semi") if exclude_unannotated else given


def resolve_targets(targets: DataFrame, key: str, background: DataFrame) -> DataFrame:
    if SET not in targets.columns:
        targets = targets.withColumn(SET, F.lit("set"))
    return targets.select(SET, key).distinct().join(background, key, "left_semi").select(SET, key)


def set_parameters(annotations: DataFrame, targets: DataFrame, key: str, background: DataFrame) -> DataFrame:
    """(set_id, attribute, population, draws, successes, hits) for every set and attribute, those without a hit included. Where ``targets`` and
    ``background`` have a column ``n``, a key stands for as many."""
    size = F.sum("n") if "n" in background.columns else F.count(F.lit(1))
    sizes = targets.groupBy(SET).agg(size.alias("draws"))
    population = background.agg(size).first()[0] or 0
    rows = annotations.select("attribute", key).distinct().join(background, key)
    totals = rows.groupBy("attribute").agg(size.alias("successes"))
    hits = rows.join(targets.select(SET, key), key).groupBy(SET, "attribute").agg(size.alias("hits"))
    pairs = grid(totals, sizes)
    return pairs.join(hits, [SET, "attribute"], "left").select(
        SET, "attribute", F.lit(population).cast("long").alias("population"), "draws", "successes",
        F.coalesce("hits", F.lit(0)).alias("hits"))


def fold_enrichment() -> Column:
    ratio = (F.col("hits") / F.col("draws")) / (F.col("successes") / F.col("population"))
    return F.when((F.col("hits") > 0) & (F.col("successes") > 0), F.log2(ratio)).otherwise(F.lit(float("-inf")))


def _shape(df: DataFrame) -> DataFrame:
    return df.select(SET, F.col("attribute").alias("name"), F.col("draws").alias("samples"), F.col("hits").alias("obs"),
                     (F.col("draws") * F.col("successes") / F.col("population")).alias("exp"),
                     fold_enrichment().alias("log2_fold_enrichment"), "pval")


def finish(results: DataFrame, alpha: float = 0.05, method: str = "bh", return_nonsignificant: bool = True) -> DataFrame:
    """Correct for multiple testing inside each set and flag significance."""
    results = checkpoint(results)  # one row per set and attribute; read several times below
    out = fdr_adjust(results, "pval", [SET], method).withColumn("significant", F.coalesce(F.col("padj") <= alpha, F.lit(False)))
    return out if return_nonsignificant else out.filter("significant")


# --- flows ------------------------------------------------------------------------------------------------------------

def enrichment(annotations: DataFrame, targets: DataFrame, key: str, background: DataFrame | None = None,
               test: str = "fisher", alpha: float = 0.05, exclude_unannotated: bool = True,
               return_nonsignificant: bool = True, correction: str = "bh", reps: int = 10000, seed: int = 0,
               annotated: DataFrame | None = None) -> DataFrame:
    """Test each target set against each attribute: name, samples, obs, exp, log2 fold enrichment, p-values."""
    annotations = checkpoint(annotations.select("attribute", key).distinct())
    scope = checkpoint(resolve_background(annotations, key, background, exclude_unannotated, annotated))
    chosen = checkpoint(resolve_targets(targets, key, scope))
    pvalue = _row_test(_test(test, reps, seed))
    tested = set_parameters(annotations, chosen, key, scope).withColumn(
        "pval", pvalue("population", "draws", "successes", "hits"))
    return finish(_shape(tested), alpha, correction, return_nonsignificant)


def pathway_enrichment(members: DataFrame, names: DataFrame, targets: DataFrame, key: str, **options) -> DataFrame:
    """Enrichment in pathways (pathway, key) with their names; Benjamini-Yekutieli correction."""
    options.setdefault("correction", "by")
    res = enrichment(members.withColumnRenamed("pathway", "attribute"), targets, key, **options)
    labels = names.select(F.col("pathway").alias("name"), F.col("name").alias("pathway_name"))
    return res.join(labels, "name", "left")


def numeric_enrichment(values: DataFrame, targets: DataFrame, key: str, background: DataFrame | None = None,
                       parametric: bool = False, alpha: float = 0.05) -> DataFrame:
    """One-sample tests of numeric attributes (attribute, key, value): the target values against the background mean
    (t-test) or median (sign test). A missing target value makes the p-value missing."""
    scope = resolve_background(values, key, background)
    chosen = resolve_targets(targets, key, scope)
    rows = values.select("attribute", key, F.when(~F.isnan("value"), F.col("value")).alias("value")).join(
        scope, key, "left_semi")
    hit = rows.join(chosen, key)
    if parametric:
        centre = rows.groupBy("attribute").agg(F.avg("value").alias("exp"))
        seen = hit.groupBy(SET, "attribute").agg(
            F.count(F.lit(1)).alias("samples"), F.count("value").alias("known"), F.avg("value").alias("obs"),
            F.stddev_samp("value").alias("sd"))
        tested = seen.join(centre, "attribute").withColumn("pval", _t_pvalue("obs", "exp", "sd", "samples"))
    else:
        centre = quantiles(rows, "value", {"exp": 0.5}, ["attribute"])
        middle = quantiles(hit, "value", {"obs": 0.5}, [SET, "attribute"])
        seen = hit.join(centre, "attribute").groupBy(SET, "attribute").agg(
            F.count(F.lit(1)).alias("samples"), F.count("value").alias("known"), F.max("exp").alias("exp"),
            F.sum((F.col("value") > F.col("exp")).cast("long")).alias("above"),
            F.sum((F.col("value") < F.col("exp")).cast("long")).alias("below"))
        tested = seen.join(middle, [SET, "attribute"], "left").withColumn("pval", _sign_pvalue("above", "below"))
    complete = F.col("known") == F.col("samples")
    shaped = tested.select(SET, F.col("attribute").alias("name"), "samples", F.when(complete, F.col("obs")).alias("obs"),
                           "exp", F.when(complete, F.col("pval")).alias("pval"))
    return finish(shaped, alpha)


@F.pandas_udf(T.DoubleType())
def _t_pvalue(obs: pd.Series, exp: pd.Series, sd: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for o, e, s, m in zip(obs, exp, sd, n):
        if m < 2 or not np.isfinite([o, e, s]).all():
            out.append(math.nan)
        elif s == 0:
            out.append(math.nan if o == e else 0.0)
        else:
            out.append(stats.t_two_sided((o - e) / (s / math.sqrt(m)), m - 1))
    return pd.Series(out, dtype=float)


@F.pandas_udf(T.DoubleType())
def _sign_pvalue(above: pd.Series, below: pd.Series) -> pd.Series:
    return pd.Series([math.nan if a is None or b is None or a != a or b != b else stats.sign_test_pvalue(int(a), int(b))
                      for a, b in zip(above, below)], dtype=float)


# --- ranked lists -------------------------------------------------------------------------------------------------------

_upper_tail = _row_test(lambda population, draws, successes, hits: stats.hypergeom_sf(hits - 1, population, successes, draws))


def _mhg_pvalue(min_hits: int, lowest: int):
    @F.pandas_udf(T.DoubleType())
    def run(population: pd.Series, successes: pd.Series, stat: pd.Series) -> pd.Series:
        solved: dict[tuple, float] = {}
        for args in set(zip(population, successes, stat)):
            n, k, s = args
            solved[args] = stats.xl_mhg_pvalue(int(n), int(k), min_hits, lowest, float(s))
        return pd.Series([solved[a] for a in zip(population, successes, stat)], dtype=float)
    return run


def ranked_enrichment(annotations: DataFrame, ranked: DataFrame, key: str, rank: str = "rank",
                      min_positive: int = 10, lowest_cutoff: float = 0.25, alpha: float = 0.05,
                      correction: str = "bh") -> DataFrame:
    """XL-mHG test of a ranked list (ranks 0..n-1) from both ends; the more significant end is reported.

    Keys without any annotation leave the list first. The statistic is the smallest upper tail over the positions of an attribute's keys. Positions are numbered with
    the distributed row numbers, so an attribute that covers a third of the list is still split over tasks.
    """
    annotations = annotations.select("attribute", key).distinct()
    places, n = _list_places(annotations, ranked, key, rank)
    return finish(_ranked_tests(annotations, places, n, key, min_positive, lowest_cutoff), alpha, correction)


def _list_places(annotations: DataFrame, ranked: DataFrame, key: str, rank: str) -> tuple[DataFrame, int]:
    """(key, __r) of the annotated keys of the list, numbered from 0, and their number."""
    known = ranked.join(annotations.select(key).distinct(), key, "left_semi").select(key, rank)
    places = checkpoint(row_numbers(known, [], [rank], "__n").select(key, (F.col("__n") - 1).alias("__r")))
    return places, places.count()


def _ranked_tests(annotations: DataFrame, places: DataFrame, n: int, key: str, min_positive: int, lowest_cutoff: float) -> DataFrame:
    """One row for each attribute with a key in the list, before the correction."""
    min_hits, lowest = min(min_positive, n), min(int(math.floor(lowest_cutoff * n)), n)
    placed = annotations.join(places, key)
    totals = placed.groupBy("attribute").agg(F.count(F.lit(1)).alias("successes"))
    both = placed.select("attribute", F.inline(F.array(
        F.struct(F.lit("top").alias("end"), F.col("__r").cast("long").alias("at")),
        F.struct(F.lit("bottom").alias("end"), (F.lit(n - 1) - F.col("__r")).cast("long").alias("at")))))
    numbered = row_numbers(both.filter(F.col("at") < lowest), ["attribute", "end"], ["at"], "hits").select(
        "attribute", "end", (F.col("at") + 1).alias("draws"), "hits")
    cells = checkpoint(spread(checkpoint(numbered.filter(F.col("hits") >= min_hits).join(totals, "attribute"))).withColumn(
        "tail", _upper_tail(F.lit(n), "draws", "successes", "hits")))
    best = cells.groupBy("attribute", "end").agg(F.min(F.struct("tail", "draws", "hits")).alias("b"))
    ends = totals.select("attribute", "successes", F.explode(F.array(F.lit("top"), F.lit("bottom"))).alias("end"))
    stats_by_end = ends.join(best, ["attribute", "end"], "left").select(
        "attribute", "end", "successes", F.coalesce("b.tail", F.lit(1.0)).alias("stat"),
        F.coalesce("b.draws", F.lit(0)).alias("draws"), F.coalesce("b.hits", F.lit(0)).alias("hits"))
    scored = checkpoint(spread(checkpoint(stats_by_end), 50)
        .withColumn("pval", _mhg_pvalue(min_hits, lowest)(F.lit(n), "successes", "stat")))
    fold = F.col("hits") / (F.col("successes") * F.col("draws") / F.lit(float(n)))
    # the p-value of a perfect list is its tail, up to rounding
    reached = F.col("tail") <= F.col("pval") * (1 + 1e-9)
    escore = cells.join(scored.select("attribute", "end", "pval"), ["attribute", "end"]).filter(reached).groupBy(
        "attribute", "end").agg(F.max(fold).alias("escore"))
    merged = scored.join(escore, ["attribute", "end"], "left").withColumn("escore", F.coalesce("escore", F.lit(1.0)))
    # the forward end wins ties
    chosen = merged.groupBy("attribute").agg(F.min(F.struct(
        "pval", F.when(F.col("end") == "top", 0).otherwise(1).alias("o"), "hits", "successes", "draws", "escore")).alias("c"))
    score = F.when(F.col("c.o") == 0, F.log2("c.escore")).otherwise(-F.log2("c.escore"))
    return chosen.select(F.lit("ranked").alias(SET), F.col("attribute").alias("name"), F.lit(n).cast("long").alias("samples"),
                           F.col("c.hits").alias("obs"), (F.col("c.successes") * F.col("c.draws") / F.lit(float(n))).alias("exp"),
                           score.alias("log2_enrichment_score"), F.col("c.pval").alias("pval"))


def ranked_ontology_enrichment(annotations: DataFrame, ranked: DataFrame, key: str, nodes: DataFrame, edges: DataFrame, rank: str = "rank",
                               propagate: str = "elim", min_positive: int = 10, lowest_cutoff: float = 0.25, alpha: float = 0.05,
                               correction: str = "by") -> DataFrame:
    """XL-mHG tests of ontology terms in a ranked list. ``annotations`` is (term, key), ``nodes`` and ``edges`` as in ``ontology_enrichment``.

    ``elim`` goes deepest level first: the keys of a term that is significant at the top of the list no longer count for its ancestors. What
    ancestors have lost is carried along as (term, key) and grows by one level's terms at a time. A term that has
    lost all its keys has p-value 1 and score 0. ``weight`` and ``all.m`` are defined for sets only.
    """
    from .ontology import ancestors
    from .ontology import propagate as lift
    if propagate not in ("no", "classic", "elim"):
        raise ValueError("propagate must be no, classic or elim for a ranked list")
    rows, closure = annotations.select("term", key).distinct(), None
    if propagate != "no":
        closure = checkpoint(ancestors(edges))
        rows = lift(rows, closure, key)
    rows = checkpoint(rows.join(nodes.select("term").distinct(), "term", "left_semi").select(F.col("term").alias("attribute"), key).distinct())
    places, n = _list_places(rows, ranked, key, rank)
    if propagate != "elim":
        return finish(_ranked_tests(rows, places, n, key, min_positive, lowest_cutoff), alpha, correction)
    listed = checkpoint(rows.join(places.select(key), key, "left_semi").join(
        nodes.groupBy(F.col("term").alias("attribute")).agg(F.max("level").alias("level")), "attribute"))
    lost: DataFrame | None = None
    tested: DataFrame | None = None
    for depth in [r[0] for r in listed.select("level").distinct().orderBy(F.desc("level")).collect()]:
        here = listed.filter(F.col("level") == depth).select("attribute", key)
        left = here if lost is None else here.join(lost, ["attribute", key], "left_anti")
        found = checkpoint(_ranked_tests(left, places, n, key, min_positive, lowest_cutoff))
        bare = here.select(F.col("attribute").alias("name")).distinct().join(found.select("name"), "name", "left_anti").select(
            F.lit("ranked").alias(SET), "name", F.lit(n).cast("long").alias("samples"), F.lit(0).cast("long").alias("obs"), F.lit(0.0).alias("exp"),
            F.lit(0.0).alias("log2_enrichment_score"), F.lit(1.0).alias("pval"))
        level = found.unionByName(bare)
        tested = level if tested is None else tested.unionByName(level)
        strong = found.filter((F.col("pval") <= alpha) & (F.col("log2_enrichment_score") > 0)).select(F.col("name").alias("term"))
        more = left.withColumnRenamed("attribute", "term").join(strong, "term", "left_semi").join(closure.select("term", "ancestor"), "term").filter(
            "term <> ancestor").select(F.col("ancestor").alias("attribute"), key)
        lost = checkpoint((more if lost is None else lost.unionByName(more)).distinct())
    return finish(checkpoint(tested) if tested is not None else _ranked_tests(rows, places, n, key, min_positive, lowest_cutoff), alpha, correction)


# --- randomisation of fold changes ---------------------------------------------------------------------------------------

def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: np.ndarray) -> np.ndarray:
    """Good ones among so many draws, for each number of draws."""
    if good + bad < 1_000_000_000:  # the generator's own limit
        return rng.hypergeometric(good, bad, draws) if good + bad else np.zeros(len(draws), np.int64)
    u, out = rng.random(len(draws)), np.zeros(len(draws), np.int64)
    for n in np.unique(draws):
        # the distribution function around its mode; what lies beyond 14 deviations is below what a double can add
        mode = int((n + 1) * (good + 1) // (good + bad + 2))
        reach = int(14 * math.sqrt(n * (good / (good + bad)) * (bad / (good + bad)) + 1)) + 60
        k = np.arange(max(0, n - bad, mode - reach), min(n, good, mode + reach) + 1)
        steps = np.log((good - k[:-1]) / (k[:-1] + 1)) + np.log((n - k[:-1]) / (bad - n + k[:-1] + 1.0))
        logs = np.concatenate([[0.0], np.cumsum(steps)])
        total = np.cumsum(np.exp(logs - logs.max()))
        out[draws == n] = k[np.minimum(np.searchsorted(total / total[-1], u[draws == n], side="right"), len(k) - 1)]
    return out


def _shares(seed: int, leaf: int, path: list, n: int, reps: int) -> np.ndarray:
    """How many of each repetition's draws fall into a leaf: at each node above, its left half takes a hypergeometric share of what the node has.
    A node draws by itself from (seed, depth, node), so all leaves below see the same split."""
    share = np.full(reps, n, dtype=np.int64)
    for depth, step in enumerate(path):
        left, total = step["left"], step["total"]
        node = leaf >> (len(path) - depth)
        to_left = _hypergeometric(np.random.default_rng([seed, depth, node]), left, total - left, share)
        share = share - to_left if leaf >> (len(path) - depth - 1) & 1 else to_left
    return share


#: Rows of a leaf up to which the subsets of many repetitions are drawn together, and random numbers held for that.
SMALL_LEAF, HELD = 4096, 1 << 21


def _subset_sums(rng: np.random.Generator, x: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The sum of a random subset of ``x`` of each size in ``share``: the rows of the smallest of as many random numbers."""
    sums = np.zeros(len(share))
    for size in np.unique(share[share > 0]):
        of = np.flatnonzero(share == size)
        step = max(1, HELD // len(x))
        for at in range(0, len(of), step):
            part = of[at:at + step]
            if size == len(x):
                sums[part] = x.sum()
            else:
                sums[part] = x[np.argpartition(rng.random((len(part), len(x))), size - 1, axis=1)[:, :size]].sum(1)
    return sums


def fold_change_randomization(target: DataFrame, reference: DataFrame, key: str, column: str, alpha: float = 0.05,
                              reps: int = 10000, seed: int = 0, bucket_rows: int = 200_000) -> DataFrame:
    """Is the mean fold change of ``target`` extreme among random subsets of ``reference`` of the same size?

    Rows are dealt by a hash of key and value to the leaves of a binary tree over hash ranges, of about ``bucket_rows`` rows each. Every node
    splits a subset between its halves by a hypergeometric draw of its own, so each leaf knows its share of every subset from the sizes
    along its path, draws that many of its rows and returns one partial sum a repetition. Splits depend on the seed, the node and the rows
    below it only. Equal rows are one line with a count, so a row that repeats does not fill a task.
    """
    observed = target.agg(F.avg(column).alias("m"), F.count(column).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    expected = reference.agg(F.avg(column).alias("m"), F.count(column).alias("n")).first()
    n, obs, total = observed["n"], observed["m"], expected["n"]
    if not n or n > total:
        raise ValueError("the target needs values, and no more than the reference has")
    depth = max(0, math.ceil(math.log2(total / bucket_rows))) if total > bucket_rows else 0
    leaf = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    tagged = checkpoint(reference.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"), F.xxhash64(key, F.col(column).cast("double")).alias("h"))
                        .groupBy("h", "x").agg(F.count(F.lit(1)).alias("copies")).withColumn("leaf", leaf))
    sizes = tagged.groupBy("leaf").agg(F.sum("copies").alias("rows"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    nodes = checkpoint(sizes.select(levels.alias("depth"), "leaf", "rows").groupBy(
        "depth", F.expr(f"shiftright(leaf, {depth} - depth)").alias("node")).agg(F.sum("rows").alias("rows")))
    steps = sizes.select("leaf", levels.alias("depth")).withColumn("node", F.expr(f"shiftright(leaf, {depth} - depth)"))
    below = nodes.filter("node % 2 = 0").select((F.col("depth") - 1).alias("depth"), F.expr("shiftright(node, 1)").alias("node"), F.col("rows").alias("left"))
    walked = steps.join(nodes, ["depth", "node"]).join(below, ["depth", "node"], "left").groupBy("leaf").agg(F.array_sort(F.collect_list(
        F.struct("depth", F.coalesce("left", F.lit(0)).alias("left"), F.col("rows").alias("total")))).alias("path"))

    def draw(rows: pd.DataFrame, walk: pd.DataFrame) -> pd.DataFrame:
        own, rows = int(walk["own"].iloc[0]), rows.sort_values(["h", "x"])
        x, upto = rows["x"].to_numpy(), np.cumsum(rows["copies"].to_numpy())
        share = _shares(seed, own, walk["path"].iloc[0][:depth], n, reps)
        rng, sums = np.random.default_rng([seed, depth, own, 1]), np.zeros(reps)
        if upto[-1] <= SMALL_LEAF:
            return pd.DataFrame({"rep": np.arange(reps), "part": _subset_sums(rng, np.repeat(x, rows["copies"].to_numpy()), share)})
        for r in np.flatnonzero(share):
            places = rng.choice(int(upto[-1]), int(share[r]), replace=False, shuffle=False)
            sums[r] = x[np.searchsorted(upto, places, side="right")].sum()
        return pd.DataFrame({"rep": np.arange(reps), "part": sums})

    parts = tagged.groupBy("leaf").cogroup(checkpoint(walked.withColumnRenamed("leaf", "own")).groupBy("own")).applyInPandas(draw, "rep long, part double")
    sums = parts.groupBy("rep").agg((F.sum("part") / F.lit(float(n))).alias("mean"))
    # a subset that is the target itself may differ from it in the last bit
    slack = 1e-12 * max(1.0, abs(obs))
    beyond = F.col("mean") >= F.lit(obs - slack) if obs > expected["m"] else F.col("mean") <= F.lit(obs + slack)
    pval = (F.sum(beyond.cast("long")) + 1) / F.lit(float(reps + 1))
    return sums.agg(pval.alias("pval")).select(
        F.lit(observed["rows"]).cast("long").alias("group_size"), F.lit(obs).alias("observed_fold_change"),
        F.lit(expected["m"]).alias("expected_fold_change"), "pval", (F.col("pval") <= alpha).alias("significant"))


# --- ontology-aware tests -----------------------------------------------------------------------------------------------

PROPAGATION = ("classic", "elim", "weight", "all.m", "no")


def ontology_enrichment(annotations: DataFrame, targets: DataFrame, key: str, nodes: DataFrame, edges: DataFrame,
                        background: DataFrame | None = None, propagate: str = "elim", test: str = "fisher",
                        alpha: float = 0.05, correction: str = "by", return_nonsignificant: bool = True) -> DataFrame:
    """Enrichment in ontology terms. ``annotations`` is (term, key); ``nodes`` has term, level and namespace;
    ``edges`` is (child, parent) of the relations to follow."""
    from .ontology import ancestors
    from .ontology import propagate as lift
    if propagate not in PROPAGATION:
        raise ValueError(f"propagate must be one of {PROPAGATION}")
    if propagate in ("weight", "all.m") and test != "fisher":
        raise ValueError("the weight and all.m methods need Fisher's exact test")
    closure = None
    rows, chosen, counts = _alike(annotations.join(resolve_background(annotations, key, background), key, "left_semi"), targets, key)
    if propagate != "no":
        closure = stored(ancestors(edges))
        rows = lift(rows, closure, key)
    rows = stored(rows.join(nodes.select("term").distinct(), "term", "left_semi").join(counts, key))
    scope = stored(rows.select(key, "n").distinct())
    chosen = stored(chosen.join(scope, key))
    attributes = rows.withColumnRenamed("term", "attribute")
    params = stored(set_parameters(attributes, chosen, key, scope))
    fn = _row_test(_test(test))
    if propagate in ("classic", "no"):
        tested = params.withColumn("pval", fn("population", "draws", "successes", "hits"))
    elif propagate == "elim":
        tested = _elim(params, rows, chosen, key, nodes, closure, fn, alpha)
    elif propagate == "weight":
        tested = _weight(params, rows, chosen, key, nodes, edges, closure, fn)
    else:
        tested = _combine(params.withColumn("pval", fn("population", "draws", "successes", "hits")),
                          _elim(params, rows, chosen, key, nodes, closure, fn, alpha),
                          _weight(params, rows, chosen, key, nodes, edges, closure, fn))
    out = finish(_shape(tested), alpha, correction, return_nonsignificant)
    info = nodes.select(F.col("term").alias("name"), "level", *[c for c in ("namespace",) if c in nodes.columns])
    return out.join(info, "name")


def order_by_level(results: DataFrame) -> DataFrame:
    """Most specific terms first."""
    return results.orderBy(F.desc("level"), "padj", "name")


def top_results(results: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most significant rows, as a bar chart would show them."""
    return results.orderBy(F.asc_nulls_last("padj"), F.asc_nulls_last("pval"), SET, "name").limit(n)


def _alike(annotations: DataFrame, targets: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term, key), (set_id, key) and (key, n): one key for all that have the same terms and are in the same sets, with their number. No test
    tells such keys apart, so what follows works on as many rows as there are kinds of keys."""
    known = annotations.filter(F.col("term").isNotNull() & F.col(key).isNotNull())
    terms = known.groupBy(key).agg(F.sort_array(F.collect_set("term")).alias("terms"))
    sets = resolve_targets(targets, key, known.select(key).distinct()).groupBy(key).agg(F.sort_array(F.collect_set(F.struct(SET))).alias("sets"))
    kinds = stored(terms.join(sets, key, "left").groupBy("terms", "sets").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n")))
    return (kinds.select(F.explode("terms").alias("term"), key), kinds.select(F.explode("sets").alias("s"), key).select(f"s.{SET}", key),
            kinds.select(key, "n"))


def _sized(rows: DataFrame) -> DataFrame:
    return rows if "n" in rows.columns else rows.withColumn("n", F.lit(1).cast("long"))


def _elim(params: DataFrame, rows: DataFrame, targets: DataFrame, key: str, nodes: DataFrame, closure: DataFrame,
          fn, alpha: float) -> DataFrame:
    """Deepest level first: genes of a significant, enriched term no longer count for its ancestors.

    Terms of one level are never ancestors of each other, so a level is one aggregate. What a term has lost is the
    union of its significant descendants' genes, so only the list of significant terms is carried along. A gene of ``rows`` stands for ``n`` if there
    is such a column.
    """
    rows = _sized(rows)
    flagged = params.withColumn("score", fold_enrichment()).join(
        nodes.select(F.col("term").alias("attribute"), "level"), "attribute")
    flagged = stored(flagged)
    depths = [r["level"] for r in flagged.select("level").distinct().orderBy(F.desc("level")).collect()]
    done: list[DataFrame] = []
    significant: DataFrame | None = None
    for depth in depths:
        here = flagged.filter(F.col("level") == depth)
        if significant is not None:
            lost_keys = (significant.join(closure, "term").select(SET, F.col("ancestor").alias("attribute"), "term")
                         .join(here.select("attribute").distinct(), "attribute", "left_semi")
                         .join(rows.select("term", key), "term").select(SET, "attribute", key).distinct()
                         .join(rows.withColumnRenamed("term", "attribute"), ["attribute", key]))
            mine = targets.select(SET, key, F.lit(1).alias("__t"))
            lost = lost_keys.join(mine, [SET, key], "left").groupBy(SET, "attribute").agg(
                F.sum("n").alias("lost"), F.sum(F.when(F.col("__t") == 1, F.col("n")).otherwise(0)).alias("lost_hits"))
            here = here.join(lost, [SET, "attribute"], "left").fillna(0, ["lost", "lost_hits"])
        else:
            here = here.withColumn("lost", F.lit(0)).withColumn("lost_hits", F.lit(0))
        here = stored(here.withColumn("pval", fn(
            "population", "draws", F.col("successes") - F.col("lost"), F.col("hits") - F.col("lost_hits"))))
        done.append(here.select(*params.columns, "pval"))
        new = here.filter((F.col("pval") <= alpha) & (F.col("score") > 0)).select(SET, F.col("attribute").alias("term"))
        significant = new if significant is None else significant.unionByName(new)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _weight(params: DataFrame, rows: DataFrame, targets: DataFrame, key: str, nodes: DataFrame, edges: DataFrame, closure: DataFrame, fn) -> DataFrame:
    """Genes of a term carry weights that terms and their children share by significance (Alexa et al. 2006, method "weight").

    Levels go deepest first. A term is tested on its weighted genes. As long as some child is at least as significant, with the ratio
    p(term) / p(child), the genes of such children lose that factor in the term and all its ancestors, the children are done with, and the term is
    tested again. Children that are all less significant lose their ratio in their own genes. A level is worked
    through in common, one round for all its terms, on a stored table of (set, term, gene, weight). A gene of ``rows`` stands for ``n`` if there is
    such a column.
    """
    rows = _sized(rows)
    sizes = params.select(SET, F.col("attribute").alias("term"), "population", "draws")
    hit = targets.select(SET, key).distinct().withColumn("hit", F.lit(1.0))
    state = stored(grid(rows.select("term", key, "n"), sizes.select(SET).distinct()).join(hit, [SET, key], "left").select(
        SET, "term", key, "n", F.coalesce("hit", F.lit(0.0)).alias("hit"), F.lit(1.0).alias("w")))
    itself = rows.select("term").distinct()
    upward = stored(closure.select("term", F.col("ancestor").alias("up")).union(itself.select("term", F.col("term").alias("up"))))
    links = stored(edges.select(F.col("parent").alias("term"), "child").distinct())
    leveled = stored(sizes.join(nodes.select("term", "level"), "term"))

    def tested(which: DataFrame) -> DataFrame:
        s, h = F.col("s"), F.col("h")
        cells = [F.floor(c) for c in (h, s - h, F.col("draws") - h, F.col("population") - s - F.col("draws") + h)]
        sums = state.join(which.select(SET, "term").distinct(), [SET, "term"], "left_semi").groupBy(SET, "term").agg(
            F.sum(F.col("w") * F.col("n")).alias("s"), F.sum(F.col("w") * F.col("hit") * F.col("n")).alias("h"))
        return sums.join(leveled, [SET, "term"]).select(
            SET, "term", fn(cells[0] + cells[1] + cells[2] + cells[3], cells[0] + cells[2], cells[0] + cells[1], cells[0]).alias("pval"))

    done = None
    for depth in [r["level"] for r in leveled.select("level").distinct().orderBy(F.desc("level")).collect()]:
        mine = leveled.filter(F.col("level") == depth).select(SET, "term")
        if done is None:
            done = stored(tested(mine))
            continue
        left = stored(mine.join(links, "term").join(done.select(SET, F.col("term").alias("child")), [SET, "child"], "left_semi"))
        done = stored(done.unionByName(tested(mine)))
        while not left.isEmpty():
            above, below = (done.select(SET, F.col("term").alias(name), F.col("pval").alias(p)) for name, p in (("term", "pt"), ("child", "pc")))
            ratio = F.nanvl(F.col("pt") / F.greatest("pc", F.lit(1e-50)), F.lit(1.0))
            pairs = left.join(above, [SET, "term"]).join(below, [SET, "child"]).select(SET, "term", "child", ratio.alias("ratio"))
            waits = pairs.groupBy(SET, "term").agg((F.max("ratio") >= 1).alias("waits"))
            pairs = stored(pairs.join(waits, [SET, "term"]))
            rising = pairs.filter("ratio >= 1")
            shrink = pairs.filter(~F.col("waits")).groupBy(SET, F.col("child").alias("term")).agg(F.product("ratio").alias("own"))
            share = rising.join(upward, "term").select(SET, F.col("up").alias("term"), "child", "ratio").join(
                rows.select(F.col("term").alias("child"), key), "child").groupBy(SET, "term", key).agg(F.product(1 / F.col("ratio")).alias("shared"))
            state = stored(state.join(shrink, [SET, "term"], "left").join(share, [SET, "term", key], "left").select(
                SET, "term", key, "n", "hit", (F.col("w") * F.coalesce("own", F.lit(1.0)) * F.coalesce("shared", F.lit(1.0))).alias("w")))
            again = tested(shrink.select(SET, "term").union(rising.select(SET, "term"))).withColumnRenamed("pval", "new")
            done = stored(done.join(again, [SET, "term"], "left").select(SET, "term", F.coalesce("new", "pval").alias("pval")))
            left = pairs.filter("waits AND ratio < 1").select(SET, "term", "child")
    return params.join(done.withColumnRenamed("term", "attribute"), [SET, "attribute"])


def _combine(*tested: DataFrame) -> DataFrame:
    """Geometric mean of the p-values of several methods."""
    first = tested[0]
    logs = [first.withColumn("__l0", F.ln("pval")).drop("pval")]
    for i, other in enumerate(tested[1:], 1):
        logs.append(other.select(SET, "attribute", F.ln("pval").alias(f"__l{i}")))
    out = logs[0]
    for other in logs[1:]:
        out = out.join(other, [SET, "attribute"])
    total = sum((F.coalesce(F.col(f"__l{i}"), F.lit(float("-inf"))) for i in range(len(tested))), F.lit(0.0))
    return out.select(*first.columns[:-1], F.exp(total / len(tested)).alias("pval"))
