"""Special functions and tails of distributions, in numpy and math only."""

from __future__ import annotations

import math

import numpy as np


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x), by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        for _ in range(10_000):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def f_tail(x: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def kolmogorov_tail(d: float, n: int) -> float:
    """Asymptotic p-value of a Kolmogorov-Smirnov distance."""
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def normal_ppf(p: float) -> float:
    """Inverse of normal_cdf, by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def nelder_mead(f, start: np.ndarray, step: float = 0.1, rounds: int = 2000, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """The least point of f found by the downhill simplex method."""
    n = len(start)
    points = [np.asarray(start, dtype=float)]
    for i in range(n):
        p = points[0].copy()
        p[i] += step if p[i] == 0 else step * max(abs(p[i]), 0.1)
        points.append(p)
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + 1e-12) and max(np.abs(points[-1] - points[0])) < 1e-7:
            break
        centre = np.mean(points[:-1], axis=0)
        reflected = centre + (centre - points[-1])
        r = f(reflected)
        if r < values[0]:
            expanded = centre + 2 * (centre - points[-1])
            e = f(expanded)
            points[-1], values[-1] = (expanded, e) if e < r else (reflected, r)
        elif r < values[-2]:
            points[-1], values[-1] = reflected, r
        else:
            towards = reflected if r < values[-1] else points[-1]
            contracted = (centre + towards) / 2
            c = f(contracted)
            if c < min(r, values[-1]):
                points[-1], values[-1] = contracted, c
            else:
                points = [points[0]] + [(p + points[0]) / 2 for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], values[best]
