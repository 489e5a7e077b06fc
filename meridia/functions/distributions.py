"""Distribution functions on math alone: normal, t, binomial, beta."""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_cdf(z: float) -> float:
    return normal_sf(-z)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * out


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1.0 - tail


def _solve(f, lo: float, hi: float) -> float:
    """Zero of a rising function by bisection."""
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def t_ppf(p: float, df: float) -> float:
    top = 1.0
    while t_sf(top, df) > min(p, 1 - p):
        top *= 2
    x = _solve(lambda q: (1 - t_sf(q, df)) - max(p, 1 - p), 0.0, top)
    return x if p >= 0.5 else -x


def binomial_pmf(k: int, n: int, p: float = 0.5) -> float:
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def binomial_test(k: int, n: int, alternative: str = "two-sided") -> float:
    """Exact test of p = 1/2."""
    upper = math.fsum(binomial_pmf(j, n) for j in range(k, n + 1))
    lower = math.fsum(binomial_pmf(j, n) for j in range(0, k + 1))
    if alternative == "greater":
        return min(1.0, upper)
    return min(1.0, lower) if alternative == "less" else min(1.0, 2 * min(upper, lower))


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Exact interval of a binomial share."""
    half = (1 - confidence) / 2
    low = 0.0 if k == 0 else _solve(lambda p: beta_inc(k, n - k + 1, p) - half, 0.0, 1.0)
    high = 1.0 if k == n else _solve(lambda p: beta_inc(k + 1, n - k, p) - (1 - half), 0.0, 1.0)
    return low, high
