"""Statistical kernels over one group's numpy arrays, or over its sums and counted values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from meridia.functions import distributions as dist

EXACT_PAIRS, PERMUTED_PAIRS = 50, 13
NEGLIGIBLE, LEAST_EVENTS, LEAST_WINDOWS, MOST_WINDOWS = 0.147, 10, 5, 50


def midranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their mean."""
    values, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def _exact_signed_rank(n: int) -> np.ndarray:
    """How many sign patterns of ranks 1..n have each positive rank sum."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1
    for r in range(1, n + 1):
        counts[r:] = counts[r:] + counts[:-r]
    return counts


def wilcoxon(diffs: np.ndarray, alternative: str = "two-sided", zeros: str = "pratt") -> tuple[float, float]:
    """Signed-rank statistic and p.

    pratt keeps zeros in the ranking and always uses the normal approximation
    with continuity correction. wilcox drops them: exact without ties up to 50
    pairs, all sign patterns of tied or zero-holding samples up to 13, else the
    normal approximation without correction. Without any difference p is 1.
    """
    d = np.asarray(diffs, dtype=float)
    if not np.any(d):
        return 0.0, 1.0
    had_zeros = bool(np.any(d == 0))
    if zeros == "wilcox":
        d = d[d != 0]
    ranks = midranks(np.abs(d))
    tied = np.unique(np.abs(d[d != 0]), return_counts=True)[1].astype(float)
    return signed_rank_test(
        len(d), int(np.count_nonzero(d == 0)), float(ranks[d > 0].sum()), float(ranks[d < 0].sum()), float((tied**3 - tied).sum()),
        exact=not had_zeros and tied.max() == 1, ranks=ranks, alternative=alternative, zeros=zeros,
    )


def signed_rank_test(n: int, z: int, plus: float, minus: float, cubes: float, *, exact: bool, ranks: np.ndarray, alternative: str, zeros: str) -> tuple[float, float]:
    """Statistic and p from sums alone.

    n pairs are ranked, z of them are zero, cubes is the sum of t^3 - t over ties,
    exact says that nothing is tied or was zero. Ranks are read only if zeros are
    dropped and at most 13 pairs are left.
    """
    statistic = min(plus, minus) if alternative == "two-sided" else plus
    if n == z:
        return 0.0, 1.0
    if zeros == "wilcox" and exact and n <= EXACT_PAIRS:
        share = _exact_signed_rank(n) / 2.0**n
        upper, lower = share[int(round(plus)) :].sum(), share[: int(round(plus)) + 1].sum()
        return statistic, _pick(upper, lower, alternative)
    if zeros == "wilcox" and n <= PERMUTED_PAIRS:
        signs = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
        sums = signs @ ranks
        upper, lower = np.mean(sums >= plus - 1e-9), np.mean(sums <= plus + 1e-9)
        return statistic, _pick(float(upper), float(lower), alternative)
    mean = (n * (n + 1) - z * (z + 1)) / 4
    var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - 0.5 * cubes) / 24
    half = 0.5 if zeros == "pratt" else 0.0
    if alternative == "two-sided":
        return statistic, min(1.0, 2 * dist.normal_sf((abs(plus - mean) - half) / math.sqrt(var)))
    z_value = (plus - mean - half) / math.sqrt(var) if alternative == "greater" else (mean - plus - half) / math.sqrt(var)
    return statistic, dist.normal_sf(z_value)


def _pick(upper: float, lower: float, alternative: str) -> float:
    p = {"greater": upper, "less": lower}.get(alternative, 2 * min(upper, lower))
    return float(min(1.0, p))


def mcnemar(a: np.ndarray, b: np.ndarray, alternative: str = "two-sided") -> tuple[int, int, float]:
    """Discordant counts either way, and the exact p."""
    a, b = np.asarray(a, dtype=bool), np.asarray(b, dtype=bool)
    n10, n01 = int((a & ~b).sum()), int((~a & b).sum())
    return n10, n01, 1.0 if n10 + n01 == 0 else dist.binomial_test(n10, n10 + n01, alternative)


def welch(a: np.ndarray, b: np.ndarray, alternative: str = "two-sided", most: int = MOST_WINDOWS) -> dict:
    """Welch's t on window means; per-query data (more than `most` values) is refused."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    for x in (a, b):
        if len(x) > most:
            raise ValueError("more values than windows: pairing queries under load is not allowed")
        if len(x) < 2:
            raise ValueError("a variance needs two windows")
    return welch_test(len(a), float(a.mean()), float(a.var(ddof=1)), len(b), float(b.mean()), float(b.var(ddof=1)), alternative)


def welch_test(n_a: int, mean_a: float, var_a: float, n_b: int, mean_b: float, var_b: float, alternative: str = "two-sided") -> dict:
    """Welch's t from counts, means and variances."""
    va, vb = var_a / n_a, var_b / n_b
    if va + vb == 0:
        raise ValueError("neither side varies")
    diff, se = mean_a - mean_b, math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va**2 / (n_a - 1) + vb**2 / (n_b - 1))
    t = diff / se
    p = {"greater": dist.t_sf(t, df), "less": dist.t_sf(-t, df)}.get(alternative, 2 * dist.t_sf(abs(t), df))
    half = dist.t_ppf(0.975, df) * se
    return {"mean_diff": diff, "t": t, "df": df, "p": p, "low": diff - half, "high": diff + half}


def mann_whitney(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """U of the first sample and the tie-corrected normal p with continuity correction."""
    n, m = len(a), len(b)
    both = np.concatenate([a, b])
    u = float(midranks(both)[:n].sum() - n * (n + 1) / 2)
    ties = np.unique(both, return_counts=True)[1].astype(float)
    var = n * m / 12 * ((n + m + 1) - float((ties**3 - ties).sum()) / ((n + m) * (n + m - 1)))
    return u, 1.0 if var <= 0 else min(1.0, 2 * dist.normal_sf((abs(u - n * m / 2) - 0.5) / math.sqrt(var)))


def cliffs_delta(a: np.ndarray, b: np.ndarray) -> float:
    """P(a > b) - P(a < b), by ranks instead of pairs."""
    return 2 * mann_whitney(np.asarray(a), np.asarray(b))[0] / (len(a) * len(b)) - 1 if len(a) and len(b) else 0.0


def rank_biserial(diffs: np.ndarray) -> float:
    d = np.asarray(diffs)[np.asarray(diffs) != 0]
    ranks = midranks(np.abs(d)) if len(d) else np.zeros(0)
    return float((ranks[d > 0].sum() - ranks[d < 0].sum()) / ranks.sum()) if len(d) else 0.0


def resampled(counts: np.ndarray, iters: int, rng: np.random.Generator, block: int = 1 << 22) -> Iterator[np.ndarray]:
    """How often each value is drawn when as many are drawn as there are; a row an iteration.

    The draws go in blocks, so memory doesn't grow with iterations times values.
    """
    counts = np.asarray(counts, dtype=np.int64)
    n, step = int(counts.sum()), max(1, block // len(counts))
    for start in range(0, iters, step):
        yield rng.multinomial(n, counts / n, size=min(step, iters - start))


def bootstrap_ci(values: np.ndarray, statistic: str = "mean", iters: int = 10_000, seed: int = 42, alpha: float = 0.05, counts: np.ndarray | None = None, block: int = 1 << 22) -> tuple[float, float]:
    """Percentile interval of the mean or the median; values may come with their counts."""
    values = np.asarray(values, dtype=float)
    if not len(values):
        return math.nan, math.nan
    order = np.argsort(values, kind="stable")
    values, counts = values[order], np.ones(len(values), dtype=np.int64) if counts is None else np.asarray(counts, dtype=np.int64)[order]
    drawn = np.concatenate([counted_statistic(values, own, statistic) for own in resampled(counts, iters, np.random.default_rng(seed), block)])
    low, high = np.percentile(drawn, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(low), float(high)


def counted_statistic(values: np.ndarray, counts: np.ndarray, statistic: str) -> np.ndarray:
    """Mean or median of sorted values, each as often as its count says; a row of counts each."""
    n = counts.sum(axis=-1)
    if statistic == "mean":
        return counts @ values / n
    running = np.cumsum(counts, axis=-1)
    middle = [values[np.argmax(running > place[..., None], axis=-1)] for place in ((n - 1) // 2, n // 2)]
    return (middle[0] + middle[1]) / 2


def tost(diffs: np.ndarray, margin: float, *, alpha: float = 0.05, dominance: float = NEGLIGIBLE, iters: int = 10_000, seed: int = 42, windows: np.ndarray | None = None, least: int = LEAST_EVENTS) -> dict:
    """Two layers on event pairs: the domain margin, and sign dominance by bootstrap.

    With windows both are resampled by window; fewer than five are refused. Too
    few events are a labelled outcome.
    """
    d = np.asarray(diffs, dtype=float)
    own = np.zeros(len(d), dtype=np.int64) if windows is None else np.unique(windows, return_inverse=True)[1]
    k = int(own.max()) + 1 if len(d) else 0
    summed = lambda w: np.bincount(own, weights=w, minlength=k)
    sums = {"n": summed(np.ones(len(d))), "total": summed(d), "up": summed(d > 0), "down": summed(d < 0)}
    sums["apart"] = summed((d - (sums["total"] / np.maximum(sums["n"], 1))[own]) ** 2)
    return tost_from_sums(sums, margin, alpha=alpha, dominance=dominance, iters=iters, seed=seed, by_window=windows is not None, least=least)


def tost_from_sums(sums: dict[str, np.ndarray], margin: float, *, alpha: float = 0.05, dominance: float = NEGLIGIBLE, iters: int = 10_000, seed: int = 42, by_window: bool = False, least: int = LEAST_EVENTS) -> dict:
    """The same from sums, one of each by window: n, total, apart (squared distances from the mean), up and down (differences above and below 0).

    Without `by_window` the sums are added up: the margin needs mean and variance,
    and a bootstrap of signs needs no more than how many there are of each.
    """
    n, total, up, down = (float(sums[c].sum()) for c in ("n", "total", "up", "down"))
    mean = total / n if n else None
    out = {"n_events": int(n), "n_discordant": int(up + down), "mean_diff": mean, "p": None, "domain": "insufficient-n", "dominance": None, "low": None, "high": None, "dominance_verdict": "insufficient-n"}
    if n < least:
        return out
    rng = np.random.default_rng(seed)
    if not by_window:
        own = sums["total"] / np.maximum(sums["n"], 1)
        var = float((sums["apart"] + sums["n"] * (own - mean) ** 2).sum()) / (n - 1)
        if var <= 1e-24 * mean * mean:  # equal differences, but for rounding
            p = 0.0 if abs(mean) < margin else 1.0
        else:
            se = math.sqrt(var / n)
            p = max(dist.t_sf((mean + margin) / se, n - 1), dist.t_sf((margin - mean) / se, n - 1))
        drawn = np.concatenate([(c[:, 0] - c[:, 1]) / n for c in resampled(np.array([up, down, n - up - down]), iters, rng)])
    else:
        size, sums_d, sign = sums["n"], sums["total"], sums["up"] - sums["down"]
        k = len(size)
        if k < LEAST_WINDOWS:
            raise ValueError("a bootstrap over windows needs five of them")
        parts = []
        for step in _steps(iters, k):
            at = rng.integers(0, k, size=(step, k))
            drawn_n = size[at].sum(axis=1)
            parts.append((sums_d[at].sum(axis=1) / drawn_n, sign[at].sum(axis=1) / drawn_n))
        means, drawn = (np.concatenate(x) for x in zip(*parts))
        p = max(float(np.mean(means <= -margin)), float(np.mean(means >= margin)))
    low, high = (float(np.percentile(drawn, 100 * q)) for q in (alpha, 1 - alpha))
    verdict = lambda yes: "equivalent" if yes else "not-equivalent"
    return out | {"p": float(p), "domain": verdict(p < alpha), "dominance": (up - down) / n, "low": low, "high": high, "dominance_verdict": verdict(max(abs(low), abs(high)) < dominance)}


def _steps(iters: int, width: int, block: int = 1 << 22) -> list[int]:
    step = max(1, block // max(1, width))
    return [min(step, iters - k) for k in range(0, iters, step)]


def rope(diffs: np.ndarray, width: float, *, prior: float = 0.5, samples: int = 2_000, seed: int = 42, windows: np.ndarray | None = None, counts: np.ndarray | None = None, threshold: float = 0.95, least: int = LEAST_EVENTS, block: int = 1 << 21) -> dict:
    """Bayesian signed ranks with a region of practical equivalence.

    Differences may come with their counts: the Dirichlet weight of equal ones is
    that of their number. Masses left and right of the region come from sorted
    differences: for each z, the weight of all partners below a bound is a running
    sum, so a draw costs n log n and no n x n table is made. Draws go in blocks.
    """
    d = np.asarray(diffs, dtype=float)
    counts = np.ones(len(d)) if counts is None else np.asarray(counts, dtype=float)
    n = int(counts.sum())
    if n < least:
        return {"n_events": n, "p_left": None, "p_rope": None, "p_right": None, "verdict": "insufficient-n"}
    z, rng = np.concatenate([[0.0], d]), np.random.default_rng(seed)
    if windows is None:
        draw = lambda size: rng.dirichlet(np.concatenate([[prior], counts]), size=size)
    else:
        own = np.unique(windows, return_inverse=True)[1]
        k = int(own.max()) + 1
        if k < LEAST_WINDOWS:
            raise ValueError("a bootstrap over windows needs five of them")

        def draw(size: int) -> np.ndarray:
            u = rng.dirichlet(np.concatenate([[prior], np.ones(k)]), size=size)
            raw = np.concatenate([u[:, :1], u[:, 1:][:, own] * counts], axis=1)
            return raw / raw.sum(axis=1, keepdims=True)

    order = np.argsort(z, kind="stable")
    z = z[order]
    # partners with (z_i + z_j) / 2 < -width, and those that aren't > width
    below = np.searchsorted(z, -2 * width - z, side="left")
    above = np.searchsorted(z, 2 * width - z, side="right")
    won = np.zeros(3, dtype=np.int64)
    for size in _steps(samples, len(z), block):
        weights = draw(size)[:, order]
        running = np.concatenate([np.zeros((size, 1)), np.cumsum(weights, axis=1)], axis=1)
        left = (weights * running[:, below]).sum(axis=1)
        right = (weights * (running[:, -1:] - running[:, above])).sum(axis=1)
        won += np.bincount(np.argmax(np.stack([left, 1 - left - right, right]), axis=0), minlength=3)
    share = [float(x) / samples for x in won]
    return {"n_events": n, "p_left": share[0], "p_rope": share[1], "p_right": share[2], "verdict": "equivalent" if share[1] >= threshold else "not-equivalent"}
