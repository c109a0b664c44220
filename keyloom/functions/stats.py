"""Probability kernels on numpy arrays, used inside Arrow UDFs on aggregated rows."""

from __future__ import annotations

import math
from itertools import count

import numpy as np

def log_factorial(x: np.ndarray) -> np.ndarray:
    arr = np.asarray(x, float)
    return np.array([math.lgamma(v + 1) for v in arr.ravel()]).reshape(arr.shape)


def log_binomial(n, k) -> np.ndarray:
    return log_factorial(n) - log_factorial(k) - log_factorial(np.subtract(n, k))


def hypergeom_logpmf(k, population, successes, draws) -> np.ndarray:
    return (log_binomial(successes, k) + log_binomial(np.subtract(population, successes), np.subtract(draws, k))
            - log_binomial(population, draws))


def _hypergeom_sum(start: int, stop: int, step: int, population: int, successes: int, draws: int) -> float:
    """Sum of the pmf from ``start`` to ``stop``, walking away from the start in blocks until terms vanish."""
    term = math.exp(float(hypergeom_logpmf(start, population, successes, draws)))
    total, at = term, start
    while at != stop:
        block = np.arange(at, at + step * min(abs(stop - at), 4096), step, dtype=float)
        if step > 0:
            ratio = (successes - block) * (draws - block) / ((block + 1) * (population - successes - draws + block + 1))
        else:
            ratio = block * (population - successes - draws + block) / ((successes - block + 1) * (draws - block + 1))
        terms = term * np.cumprod(ratio)
        total += terms.sum()
        at += step * len(block)
        past_peak = ratio[-1] < 1
        if past_peak and terms[-1] <= total * 1e-18:
            break
        if terms[-1] == 0.0 and not past_peak:
            term = math.exp(float(hypergeom_logpmf(at, population, successes, draws)))
        else:
            term = terms[-1]
    return min(total, 1.0)


def hypergeom_cdf(k: int, population: int, successes: int, draws: int) -> float:
    low = max(0, draws + successes - population)
    high = min(successes, draws)
    if k < low:
        return 0.0
    return 1.0 if k >= high else _hypergeom_sum(k, low, -1, population, successes, draws)


def hypergeom_sf(k: int, population: int, successes: int, draws: int) -> float:
    """P(X > k)."""
    low = max(0, draws + successes - population)
    high = min(successes, draws)
    if k < low:
        return 1.0
    return 0.0 if k >= high else _hypergeom_sum(k + 1, high, 1, population, successes, draws)


def hypergeometric_pvalue(population: int, draws: int, successes: int, hits: int) -> float:
    """Lower tail when the set is poorer in the attribute than the background, upper tail otherwise."""
    if draws == 0 or hits * population < successes * draws:
        return hypergeom_cdf(hits, population, successes, draws)
    return hypergeom_sf(hits - 1, population, successes, draws)


def fisher_pvalue(population: int, draws: int, successes: int, hits: int) -> float:
    """Two-sided: total probability of the tables that are at most as likely as the observed one."""
    low, high = max(0, draws + successes - population), min(successes, draws)
    if low == high:
        return 1.0
    limit = float(hypergeom_logpmf(hits, population, successes, draws)) + math.log1p(1e-7)
    mode = min(high, max(low, (draws + 1) * (successes + 1) // (population + 2)))

    def likely(k: int) -> bool:
        return float(hypergeom_logpmf(k, population, successes, draws)) > limit

    # each side of the mode is monotone, so the cut on the far side is found by bisection
    if hits <= mode:
        near = hypergeom_cdf(hits, population, successes, draws)
        a, b = mode, high + 1
        while a < b:
            mid = (a + b) // 2
            a, b = (mid + 1, b) if likely(mid) else (a, mid)
        far = hypergeom_sf(max(a, hits + 1) - 1, population, successes, draws)
    else:
        near = hypergeom_sf(hits - 1, population, successes, draws)
        a, b = low - 1, mode
        while a < b:
            mid = -((-a - b) // 2)
            a, b = (a, mid - 1) if likely(mid) else (mid, b)
        far = hypergeom_cdf(min(a, hits - 1), population, successes, draws)
    return min(1.0, near + far)


# --- continuous tails ---------------------------------------------------------------------------------------------

def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in count(1):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            return out
        if not math.isfinite(out):
            raise ArithmeticError(f"incomplete beta did not converge for x={x}, a={a}, b={b}")


def _stirling_error(n: float) -> float:
    """log(n!) less Stirling's formula: its series, from a point where seven terms are exact, walked down to n."""
    out, at = 0.0, n
    while at < 16:
        out += (at + 0.5) * math.log1p(1 / at) - 1 if at > 0 else math.inf
        at += 1
    s = 1 / (at * at)
    return out + (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - (1 / 1188 - 691 / 360360 * s) * s) * s) * s) * s) / at


def _deviance(x: float, expected: float) -> float:
    """x log(x / expected) + expected - x without cancellation where the two are close."""
    v = (x - expected) / (x + expected)
    if abs(v) >= 0.1:
        return x * math.log(x / expected) + expected - x
    total, term, j = (x - expected) * v, 2 * x * v, 1
    while True:
        term *= v * v
        j += 2
        new = total + term / j
        if new == total:
            return total
        total = new


def _beta_front(x: float, a: float, b: float) -> float:
    """x^a (1 - x)^b / B(a, b), as a binomial probability in saddle-point form, so that no large logarithms cancel."""
    n = a + b
    log_p = (_stirling_error(n) - _stirling_error(a) - _stirling_error(b) - _deviance(a, n * x) - _deviance(b, n * (1 - x)))
    return math.exp(log_p) * math.sqrt(n / (2 * math.pi * a * b)) * a * b / n


def beta_cdf(x: float, a: float, b: float) -> float:
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    front = _beta_front(x, a, b)
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(1 - x, b, a) / b


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    if math.isinf(df):
        return math.erfc(abs(t) / math.sqrt(2))
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_upper(f: float, df1: float, df2: float) -> float:
    if math.isnan(f) or f <= 0:
        return 1.0 if f == 0 else math.nan if math.isnan(f) else 1.0
    if math.isinf(df2):
        return chi2_upper(f * df1, df1)
    return beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


def chi2_upper(x: float, df: float) -> float:
    """Upper tail of the chi-squared distribution."""
    if math.isnan(x):
        return math.nan
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - front * total
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for i in count(1):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            return front * out
        if not math.isfinite(out):
            raise ArithmeticError(f"incomplete gamma did not converge for x={x}, a={a}")


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def sign_test_pvalue(above: int, below: int) -> float:
    """Two-sided binomial test of one half on the non-ties."""
    n = above + below
    if n == 0:
        return 1.0
    k = min(above, below)
    return min(1.0, 2 * beta_cdf(0.5, n - k, k + 1))  # P(X <= k) as an incomplete beta function


def trigamma_inverse(x: float) -> float:
    """Solve trigamma(y) = x by Newton steps."""
    if x > 1e7:
        return 1 / math.sqrt(x)
    if x < 1e-6:
        return 1 / x
    y = 0.5 + 1 / x
    for _ in range(50):
        tri = trigamma(y)
        step = tri * (1 - tri / x) / tetragamma(y)
        y += step
        if -step / y < 1e-9:
            break
    return y


def digamma(x: float) -> float:
    out = 0.0
    while x < 12:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 12:
        out += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def tetragamma(x: float) -> float:
    out = 0.0
    while x < 12:
        out -= 2 / x ** 3
        x += 1
    f = 1 / (x * x)
    return out - f - f / x - f * f * (0.5 - f * (1 / 6 - f * (1 / 6 - 3 * f / 10)))


# --- minimum hypergeometric test ----------------------------------------------------------------------------------------

#: Cutoffs of a long list that are passed at once by the paths that cannot touch them.
STRIDE = 64
#: Draws that are followed one by one, and pairs of hits before and of hits drawn that are looked at one by one.
FEW_DRAWS, FEW_PAIRS = 64, 20_000


def xl_mhg_pvalue(n: int, k_total: int, min_hits: int, lowest: int, stat: float) -> float:
    """Exact p-value of the XL-mHG statistic: the share of lattice paths that touch a cell (cutoff, hits) whose upper tail is at most ``stat``.

    For a number of hits those are the cutoffs up to a last one, which rises with the hits. So a path touches one if its k-th hit comes no later
    than that of k, for some k; the hits are followed from one such cutoff to the next, at most one step for each hit and none for the
    cutoffs between, and what is lost on the way is added up, which keeps small p-values exact. On long lists cutoffs are taken ``STRIDE`` at a time:
    only hits that can reach one of them go step by step, those too few for it go to the last one at once.
    """
    if stat >= 1 or k_total == 0 or k_total == n:
        return 1.0
    touched = _touched(n, k_total, max(1, min_hits), lowest, stat * (1 + 1e-11))
    lost, at, alive, first = 0.0, 0, np.ones(1), 0
    while first < len(touched):
        steps = touched[first:first + (STRIDE if len(alive) > 8 * STRIDE else 1)]
        # below ``far`` hits no path comes to a cutoff of the stride
        far = max(0, min(k - _most_hits(last - at, k_total, n - at) for k, last in steps)) if len(steps) > 1 else 0
        start = at
        near = alive[far:]
        for k, last in steps:
            near = _hits_soon(near, far, n - at, k_total, last - at)
            lost, near, at = lost + float(near[k - far:].sum()), near[:k - far], last
        low = _hits_later(alive[:far], n - start, k_total, at - start)
        alive = np.zeros(max(len(low), far + len(near)))
        alive[:len(low)] = low
        alive[far:far + len(near)] += near
        first += len(steps)
    return min(1.0, lost)


def _touched(n: int, k_total: int, min_hits: int, lowest: int, bound: float) -> list[tuple[int, int]]:
    """(hits, last cutoff at which their tail is within ``bound``), rising in both. From one to the next the tail is carried by the probabilities of single
    steps; where it comes close to the bound, and now and then, it is summed anew."""
    out: list[tuple[int, int]] = []
    at, k, top = 0, min_hits, min(k_total, lowest)
    while k <= top:
        last = _last_cutoff(n, k_total, k, max(at, k), lowest, bound)
        if last is None:
            k += 1
            continue
        if last > at:
            out.append((k, last))
            at = last
        if last == lowest:
            break
        k += 1
        if bound < 1e-200 or not max(0, at + k_total - n) <= k <= min(at, top):
            continue
        tail, p, carried = hypergeom_sf(k - 1, n, k_total, at), math.exp(float(hypergeom_logpmf(k, n, k_total, at))), 0
        # n - K - c + k and K - k stay positive where the steps below divide or the row could not go on
        while k <= top and k <= at and tail > 0 and p > 0 and carried < 1000:
            while at < lowest and n - k_total - at + k > 0:
                before = p * k * (n - k_total - at + k) / ((k_total - k + 1.0) * (at - k + 1.0))
                more = tail + before * (k_total - k + 1.0) / (n - at)
                if more > bound * (1 - 1e-6) and (more > bound * (1 + 1e-6) or hypergeom_sf(k - 1, n, k_total, at + 1) > bound):
                    break
                p *= (n - k_total - at + k) / (at - k + 1.0) * (at + 1.0) / (n - at)
                tail, at, carried = more, at + 1, carried + 1
            if n - k_total - at + k <= 0:
                break
            if at > out[-1][1]:
                out.append((k, at))
            if at == lowest:
                return out
            tail -= p
            p *= (k_total - k) * (at - k) / ((k + 1.0) * (n - k_total - at + k + 1.0))
            k, carried = k + 1, carried + 1
    return out


def _last_cutoff(n: int, k_total: int, k: int, low: int, high: int, bound: float) -> int | None:
    """The largest cutoff from ``low`` to ``high`` at which the tail of ``k`` hits is within ``bound``: strides that double, then halves."""
    inside = lambda cutoff: hypergeom_sf(k - 1, n, k_total, cutoff) <= bound
    if low > high or not inside(low):
        return None
    step = 1
    while low + step <= high and inside(low + step):
        low, step = low + step, 2 * step
    high = min(high, low + step - 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if inside(middle) else (low, middle - 1)
    return low


def _most_hits(draws: int, k_total: int, left: int) -> int:
    """Hits of ``draws`` among ``left`` keys that are exceeded with a probability of at most 1e-40."""
    mean = draws * k_total / left
    # the tail from x on is at most exp(-(x ln(x / mean) - x + mean))
    low, high = mean, mean + 14 * math.sqrt(mean + 1) + 60
    while mean > 0 and high - low > 0.5:
        x = (low + high) / 2
        low, high = (low, x) if x * math.log(x / mean) - x + mean >= 93 else (x, high)
    return int(min(draws, k_total, math.ceil(high)))


def _hits_later(alive: np.ndarray, left: int, k_total: int, draws: int) -> np.ndarray:
    """Probabilities of each number of hits after ``draws`` more of the ``left`` keys, from those before. The hits of a step are a band around their mean,
    wide enough for tails of 1e-40; its probabilities follow from their ratios, so they are as exact for long lists as for short ones."""
    before = np.flatnonzero(alive > 1e-60 * alive.max(initial=0.0))
    if not len(before):
        return np.zeros(len(alive))
    band = _most_hits(draws, k_total, left)
    lowest, most = int(before[0]), int(before[-1])
    if len(before) * band > FEW_PAIRS and most + band < k_total and left - draws - k_total + lowest > 0:
        found = _hits_by_counts(alive[lowest:most + 1], lowest, left, k_total, draws, band)
        if found is not None:
            return found
    successes = k_total - before[:, None].astype(float)
    d = np.arange(band, dtype=float)[None, :]
    more = left - successes - draws + d + 1  # not positive where fewer hits are impossible
    chance = np.maximum(successes - d, 0) * (draws - d)
    if band < 400:  # terms from the first stay finite
        share = np.concatenate([np.ones((len(before), 1)), np.cumprod(np.where(more > 0, chance / ((d + 1) * np.maximum(more, 1)), 1.0), axis=1)], axis=1)
        share[:, :-1][more <= 0] = 0.0
    else:
        with np.errstate(divide="ignore"):
            steps = np.where(more > 0, np.log(chance) - np.log((d + 1) * np.maximum(more, 1)), 0.0)
        logs = np.concatenate([np.zeros((len(before), 1)), np.cumsum(steps, axis=1)], axis=1)
        logs[:, :-1][more <= 0] = -np.inf
        share = np.exp(logs - logs.max(axis=1, keepdims=True))
    share *= (alive[before] / share.sum(axis=1))[:, None]
    return np.bincount((before[:, None] + np.arange(band + 1)[None, :]).reshape(-1), weights=share.reshape(-1))


def _hits_soon(alive: np.ndarray, lowest: int, left: int, k_total: int, draws: int) -> np.ndarray:
    """``_hits_later`` from probabilities of ``lowest`` hits and more, draw by draw where there are few."""
    if draws > FEW_DRAWS:
        return _hits_later(np.concatenate([np.zeros(lowest), alive]), left, k_total, draws)[lowest:] if len(alive) else alive
    out = np.concatenate([alive, np.zeros(draws)])
    hit = k_total - lowest - np.arange(len(out), dtype=float)
    miss = left - hit
    for _ in range(draws):
        moved = out * hit
        out *= miss
        out[1:] += moved[:-1]
        out /= left
        miss -= 1
        left -= 1
    return out


def _hits_by_counts(alive: np.ndarray, lowest: int, left: int, k_total: int, draws: int, band: int) -> np.ndarray | None:
    """``_hits_later`` for many numbers of hits, all of them possible. A probability is a number of paths so far times that of ways to go on, binom(left, K - hits);
    paths branch alike everywhere, so their numbers are folded with binom(draws, .). Both are weighted by the odds of a hit at the middle, which keeps them finite, else there is no answer."""
    h = lowest + np.arange(len(alive) + band, dtype=float)
    middle = lowest + len(alive) / 2
    odds = (k_total - middle) / (left - k_total + middle)
    before = np.log((k_total - h[:len(alive) - 1]) / ((left - k_total + h[:len(alive) - 1] + 1) * odds))
    after = np.log((k_total - h[:-1]) / ((left - draws - k_total + h[:-1] + 1) * odds))
    ways, later = (np.concatenate([[0.0], np.cumsum(x)]) for x in (before, after))
    if max(np.ptp(ways), np.ptp(later)) > 600:
        return None
    d = np.arange(band, dtype=float)
    drawn = np.concatenate([[0.0], np.cumsum(np.log((draws - d) / (d + 1) * odds))])
    out = np.convolve(alive * np.exp(ways.max() - ways), np.exp(drawn - drawn.max())) * np.exp(later - later.max())
    return np.concatenate([np.zeros(lowest), out * (alive.sum() / out.sum())])
