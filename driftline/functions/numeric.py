"""Estimators over one segment or one sample, as plain numpy functions; the operators run them for each series."""

from __future__ import annotations

import math

import numpy as np

from .special import chi2_tail, f_tail, kolmogorov_tail, nelder_mead, normal_cdf, normal_ppf

# --- spectra and decomposition ----------------------------------------------


def periodogram(x: np.ndarray, dt: float, detrend: str = "linear") -> tuple[np.ndarray, np.ndarray]:
    """(frequency, power density), one-sided, boxcar."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    if detrend == "linear":
        t = np.arange(n) - (n - 1) / 2
        x = x - x.mean() - t * ((t @ x) / (t @ t) if n > 1 else 0.0)
    else:
        x = x - x.mean()
    p = np.abs(np.fft.rfft(x)) ** 2 * dt / n
    p[1 : None if n % 2 else -1] *= 2
    return np.fft.rfftfreq(n, dt), p


def peak_ratio(x: np.ndarray, dt: float, centre: float, width: float, base: tuple[float, float], excluded: list[tuple[float, float]] | None = None) -> float:
    """Highest power near a period over the median power of a band of periods."""
    f, p = periodogram(x, dt)
    with np.errstate(divide="ignore"):
        period = 1.0 / f
    peak = np.abs(period - centre) < width
    floor = (period > base[0]) & (period < base[1])
    for c, w in excluded if excluded is not None else [(centre, width)]:
        floor &= ~(np.abs(period - c) < w)
    if not peak.any() or not floor.any():
        return math.nan
    return float(p[peak].max() / np.median(p[floor]))


def dominant_period(x: np.ndarray, dt: float, low: float, high: float) -> float:
    f, p = periodogram(x, dt)
    with np.errstate(divide="ignore"):
        period = 1.0 / f
    band = (period >= low) & (period <= high)
    return float(period[band][p[band].argmax()]) if band.any() else math.nan


def harmonic_design(hours: np.ndarray, components: list[tuple[float, int]]) -> np.ndarray:
    """Columns 1, then cos and sin of each harmonic of each (period, harmonics)."""
    columns = [np.ones(len(hours))]
    for period, count in components:
        for k in range(1, count + 1):
            w = 2 * np.pi * k / period * hours
            columns += [np.cos(w), np.sin(w)]
    return np.stack(columns, axis=1)


def boxcox(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Transformed values and the power of highest likelihood, by golden section on [-5, 5]."""
    logs = np.log(x)

    def value(lam: float) -> np.ndarray:
        return logs if abs(lam) < 1e-12 else np.expm1(lam * logs) / lam

    def loss(lam: float) -> float:
        return -((lam - 1) * logs.sum() - len(x) / 2 * math.log(max(value(lam).var(), 1e-300)))

    grid = np.linspace(-5, 5, 41)
    k = int(np.argmin([loss(g) for g in grid]))
    lo, hi = grid[max(0, k - 1)], grid[min(40, k + 1)]
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    lam = (lo + hi) / 2
    return value(lam), float(lam)


def ssa(x: np.ndarray, window: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(series of each component, share of variance of each): singular spectrum analysis by the lag Gram matrix."""
    n = len(x)
    k = n - window + 1
    if k <= window:
        raise ValueError("the series must be longer than twice the window")
    hankel = np.lib.stride_tricks.sliding_window_view(x, window)  # k x window
    values, vectors = np.linalg.eigh(hankel.T @ hankel)
    order = np.argsort(-values)[:components]
    counts = np.minimum(np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)), window)
    out = [np.convolve(hankel @ vectors[:, i], vectors[:, i]) / counts for i in order]
    return np.stack(out), np.maximum(values[order], 0) / np.maximum(values, 0).sum()


def w_correlation(parts: np.ndarray) -> np.ndarray:
    """Weighted correlations of components, with triangular weights."""
    n = parts.shape[1]
    w = np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)).astype(float)
    gram = (parts * w) @ parts.T
    d = np.sqrt(np.diag(gram))
    return gram / np.outer(d, d)


def _loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: int, weights: np.ndarray) -> np.ndarray:
    """Local straight lines with tricube weights over the span nearest points."""
    n = len(x)
    q = min(span, n)
    out = np.empty(len(at))
    for i, c in enumerate(at):
        far = np.abs(x - c)
        h = np.partition(far, q - 1)[q - 1] * (span / n if span > n else 1.0)
        w = np.clip(1 - (far / max(h, 1e-12) * 0.999999) ** 3, 0, None) ** 3 * weights
        total = w.sum()
        if total <= 0:
            out[i] = y.mean()
            continue
        mx, my = (w * x).sum() / total, (w * y).sum() / total
        sxx = (w * (x - mx) ** 2).sum()
        out[i] = my + ((w * (x - mx) * (y - my)).sum() / sxx * (c - mx) if sxx > 1e-12 else 0.0)
    return out


def _moving(x: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(x, np.ones(n) / n, mode="valid")


def stl(y: np.ndarray, period: int = 12, seasonal: int = 7, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, rest): seasonal-trend decomposition by local regression (Cleveland et al. 1990), robust."""
    n = len(y)
    trend_span = int(math.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    trend_span += 1 - trend_span % 2
    low_span = period + 1 - period % 2
    t = np.arange(n, dtype=float)
    trend, season, weights = np.zeros(n), np.zeros(n), np.ones(n)
    for _ in range(max(1, outer)):
        for _ in range(inner):
            flat = y - trend
            cycle = np.empty(n + 2 * period)
            for p in range(period):
                v = flat[p::period]
                k = np.arange(len(v), dtype=float)
                cycle[p::period][: len(v) + 2] = _loess(k, v, np.arange(-1.0, len(v) + 1), seasonal, weights[p::period])
            low = _moving(_moving(_moving(cycle, period), period), 3)
            low = _loess(t, low, t, low_span, np.ones(n))
            season = cycle[period : period + n] - low
            trend = _loess(t, y - season, t, trend_span, weights)
        rest = y - trend - season
        h = 6 * np.median(np.abs(rest))
        if outer == 0 or h == 0:
            break
        u = np.clip(np.abs(rest) / h, 0, 1)
        weights = np.maximum((1 - u**2) ** 2, 1e-9)
    return trend, season, y - trend - season


# --- dependence and tests ---------------------------------------------------


def acf(x: np.ndarray, lags: int) -> np.ndarray:
    """Autocorrelations at 0..lags, sums over all n."""
    x = np.asarray(x, dtype=float) - np.mean(x)
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x, size)
    c = np.fft.irfft(f * np.conj(f), size)[: lags + 1]
    return c / c[0] if c[0] > 0 else np.concatenate([[1.0], np.zeros(lags)])


def pacf(x: np.ndarray, lags: int) -> np.ndarray:
    """Partial autocorrelations by the Levinson-Durbin recursion."""
    r = acf(x, lags)
    phi = np.zeros(lags + 1)
    out = np.ones(lags + 1)
    error = 1.0
    for k in range(1, lags + 1):
        a = (r[k] - phi[1:k] @ r[k - 1 : 0 : -1]) / error if error > 1e-15 else 0.0
        phi[1:k] = phi[1:k] - a * phi[k - 1 : 0 : -1]
        phi[k] = out[k] = a
        error *= 1 - a * a
    return out


def integral_timescale(x: np.ndarray, dt: float, max_lag: int = 2000, consecutive: int = 5) -> tuple[float, int, bool]:
    """(timescale, cut-off lag, whether the search ended without one): the sum of autocorrelations before the first of `consecutive` lags inside the band of no significance."""
    n = len(x)
    rho = acf(x, min(max_lag, n // 3) if n >= 9 else max(1, n - 1))
    inside = np.abs(rho) < 1.96 / math.sqrt(n)
    cut = next((k for k in range(1, len(rho) - consecutive + 1) if inside[k : k + consecutive].all()), None)
    at = len(rho) - 1 if cut is None else cut
    return dt * (1 + 2 * float(rho[1:at].sum())), at, cut is None


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, standard errors, residual sum of squares)."""
    q, r = np.linalg.qr(x)
    beta = np.linalg.solve(r, q.T @ y)
    rest = y - x @ beta
    rss = float(rest @ rest)
    inverse = np.linalg.inv(r)
    return beta, np.sqrt(np.maximum((inverse**2).sum(axis=1) * rss / max(1, len(y) - x.shape[1]), 0)), rss


# Response surface of the Dickey-Fuller distribution with a constant (MacKinnon 1994), for one series.
_DF_MAX, _DF_MIN, _DF_STAR = 2.74, -18.83, -1.61
_DF_SMALL = (2.1659, 1.4412, 0.038269)
_DF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def adf(x: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p, lags) of the augmented Dickey-Fuller test with a constant, lags by AIC."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    d = np.diff(x)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(skip, len(d))
        return d[rows], np.stack([x[rows], *(d[rows - k] for k in range(1, lags + 1)), np.ones(len(rows))], axis=1)

    best, lags = math.inf, 0
    for k in range(most + 1):
        y, z = design(k, most)
        _, _, rss = ols(y, z)
        aic = len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * z.shape[1]
        if aic < best:
            best, lags = aic, k
    y, z = design(lags, lags)
    beta, se, _ = ols(y, z)
    t = float(beta[0] / se[0])
    if t > _DF_MAX:
        p = 1.0
    elif t < _DF_MIN:
        p = 0.0
    else:
        p = normal_cdf(sum(c * t**k for k, c in enumerate(_DF_SMALL if t <= _DF_STAR else _DF_LARGE)))
    return t, p, lags


# Critical points of the KPSS test for a level, and their tail probabilities.
_KPSS = ((0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01))


def kpss(x: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p within 0.01 and 0.1, lags) of the KPSS test for a level, lags by Hobijn et al."""
    e = np.asarray(x, dtype=float) - np.mean(x)
    n = len(e)
    cover = int(n ** (2 / 9))
    s0, s1 = float(e @ e) / n, 0.0
    for i in range(1, cover + 1):
        c = float(e[i:] @ e[:-i]) * 2 / n
        s0 += c
        s1 += i * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    long_run = float(e @ e) / n + sum(2 * (1 - i / (lags + 1)) * float(e[i:] @ e[:-i]) / n for i in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum()) / (n * n * long_run)
    return stat, float(np.interp(stat, *_KPSS)), lags


def ljung_box(x: np.ndarray, lags: tuple[int, ...] = (6, 12, 24, 48)) -> list[tuple[int, float, float]]:
    n = len(x)
    r = acf(x, max(lags))
    parts = np.cumsum(r[1:] ** 2 / (n - np.arange(1, max(lags) + 1)))
    return [(k, q := n * (n + 2) * float(parts[k - 1]), chi2_tail(q, k)) for k in lags]


def arch_lm(x: np.ndarray, lags: tuple[int, ...] = (6, 12, 24, 48)) -> list[tuple[int, float, float, float, float]]:
    """(lags, LM, its p, F, its p) of Engle's test."""
    e = np.asarray(x, dtype=float) ** 2
    out = []
    for k in lags:
        y = e[k:]
        z = np.stack([np.ones(len(y)), *(e[k - j : len(e) - j] for j in range(1, k + 1))], axis=1)
        _, _, rss = ols(y, z)
        tss = float(((y - y.mean()) ** 2).sum())
        r2 = 1 - rss / tss
        f = (tss - rss) / k / (rss / (len(y) - k - 1))
        out.append((k, len(y) * r2, chi2_tail(len(y) * r2, k), f, f_tail(f, k, len(y) - k - 1)))
    return out


def mann_kendall(x: np.ndarray, t: np.ndarray, alpha: float = 0.05) -> dict:
    """Trend test with the variance correction of Hamed and Rao, and Sen's slope; no tie correction."""
    n = len(x)
    if n < 8:
        return {"n": n, "verdict": "too_short"}
    i, j = np.triu_indices(n, 1)
    s = float(np.sign(x[j] - x[i]).sum())
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    z = ranks - ranks.mean()
    denominator = float(z @ z)
    factor = 0.0
    for k in range(1, n - 1):
        r = float(z[:-k] @ z[k:]) / denominator if denominator else 0.0
        if r > (-1 + 1.96 * math.sqrt(n - 2)) / (n - 1):
            factor += (n - k) * (n - k - 1) * (n - k - 2) * r
    factor = max(1.0, 1 + 2 / (n * (n - 1) * (n - 2)) * factor)
    variance = n * (n - 1) * (2 * n + 5) / 18 * factor
    score = (s - np.sign(s)) / math.sqrt(variance)
    p = 2 * (1 - normal_cdf(abs(score)))
    apart = t[j] - t[i]
    slope = float(np.median((x[j] - x[i])[apart != 0] / apart[apart != 0]))
    return {"n": n, "s": s, "correction": factor, "z": float(score), "p": p, "sen_slope": slope, "verdict": ("increasing" if s > 0 else "decreasing") if p < alpha else "no_trend"}


def pelt(x: np.ndarray, penalty: float, min_size: int = 2, jump: int = 5) -> list[int]:
    """Change points of least squared cost plus penalty for each (Killick et al. 2012); ends of segments, the last left out."""
    n = len(x)
    s, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(np.square(x))])
    cost = lambda a, b: s2[b] - s2[a] - (s[b] - s[a]) ** 2 / (b - a)
    ends = [k for k in range(0, n, jump) if k >= min_size] + [n]
    best: dict[int, tuple[float, int]] = {0: (-penalty, -1)}
    alive = [0]
    for b in ends:
        choices = [(best[a][0] + cost(a, b) + penalty, a) for a in alive if b - a >= min_size]
        if not choices:
            continue
        best[b] = min(choices)
        alive = [a for a in alive if b - a < min_size or best[a][0] + cost(a, b) <= best[b][0]] + [b]
    out, at = [], n
    while at > 0:
        at = best[at][1]
        if at > 0:
            out.append(at)
    return out[::-1]


# --- distributions and extremes ---------------------------------------------


def fit_distribution(x: np.ndarray, name: str) -> tuple[tuple[float, float, float], float]:
    """((shape, location, scale), negative log likelihood) of rayleigh, weibull or lognormal; rayleigh's shape is 2."""
    x = np.asarray(x, dtype=float)
    n, low = len(x), float(x.min())
    spread = float(x.std()) or 1e-9

    def loss(p: np.ndarray) -> float:
        loc = low - math.exp(p[0])
        y = x - loc
        if name == "rayleigh":
            scale2 = float((y * y).mean()) / 2
            return -float(np.log(y).sum()) + n * math.log(scale2) + n
        if name == "lognormal":
            logs = np.log(y)
            sd = max(float(logs.std()), 1e-9)
            return float(logs.sum()) + n * math.log(sd) + n / 2 * (1 + math.log(2 * math.pi))
        k = math.exp(min(p[1], 5.0))
        powered = y**k
        scale_k = max(float(powered.mean()), 1e-300)
        return -(n * math.log(k) - n * math.log(scale_k) + (k - 1) * float(np.log(y).sum()) - n)

    start = np.array([math.log(0.1 * spread), 0.5])[: 2 if name == "weibull" else 1]
    best, value = nelder_mead(loss, start, 0.5, 600)
    loc = low - math.exp(best[0])
    y = x - loc
    if name == "rayleigh":
        return (2.0, loc, math.sqrt(float((y * y).mean()) / 2)), value
    if name == "lognormal":
        return (float(np.log(y).std()), loc, math.exp(float(np.log(y).mean()))), value
    k = math.exp(min(best[1], 5.0))
    return (k, loc, float((y**k).mean()) ** (1 / k)), value


def distribution_cdf(x: np.ndarray, name: str, parameters: tuple[float, float, float]) -> np.ndarray:
    shape, loc, scale = parameters
    y = np.maximum((np.asarray(x, dtype=float) - loc) / scale, 0)
    if name == "rayleigh":
        return 1 - np.exp(-y * y / 2)
    if name == "weibull":
        return 1 - np.exp(-(y**shape))
    return np.array([normal_cdf(math.log(v) / shape) if v > 0 else 0.0 for v in y])


def distribution_ppf(q: np.ndarray, name: str, parameters: tuple[float, float, float]) -> np.ndarray:
    shape, loc, scale = parameters
    q = np.asarray(q, dtype=float)
    if name == "rayleigh":
        return loc + scale * np.sqrt(-2 * np.log1p(-q))
    if name == "weibull":
        return loc + scale * (-np.log1p(-q)) ** (1 / shape)
    return loc + scale * np.exp(shape * np.array([normal_ppf(p) for p in q]))


def ks_distance(x: np.ndarray, name: str, parameters: tuple[float, float, float]) -> tuple[float, float]:
    """(distance, asymptotic p)."""
    f = distribution_cdf(np.sort(x), name, parameters)
    n = len(f)
    i = np.arange(1, n + 1)
    d = float(max((i / n - f).max(), (f - (i - 1) / n).max()))
    return d, kolmogorov_tail(d, n)


def anderson_normal(x: np.ndarray) -> float:
    z = (np.sort(x) - np.mean(x)) / np.std(x, ddof=1)
    f = np.clip([normal_cdf(v) for v in z], 1e-15, 1 - 1e-15)
    n = len(f)
    i = np.arange(1, n + 1)
    return float(-n - ((2 * i - 1) / n * (np.log(f) + np.log(1 - f[::-1]))).sum())


def weibull_moments(x: np.ndarray) -> tuple[float, float]:
    """(shape, scale) with location 0 from mean and population deviation, the shape by bisection of the coefficient of variation."""
    x = x[x > 0]
    mean, sd = float(x.mean()), float(x.std())
    if not (mean > 0 and sd > 0):
        raise ValueError("mean and deviation must be positive")
    return weibull_from_moments(mean, sd)


def weibull_from_moments(mean: float, sd: float) -> tuple[float, float]:
    cv = sd / mean
    gap = lambda k: math.sqrt(max(math.exp(math.lgamma(1 + 2 / k) - 2 * math.lgamma(1 + 1 / k)) - 1, 0)) - cv
    lo, hi = 0.05, 50.0
    if gap(lo) < 0 or gap(hi) > 0:
        raise ValueError("no shape within 0.05 and 50")
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gap(mid) > 0 else (lo, mid)
    k = (lo + hi) / 2
    return k, mean / math.gamma(1 + 1 / k)


def gpd_fit(excess: np.ndarray) -> tuple[float, float]:
    """(shape, scale) of highest likelihood with location 0, by the profile in shape / scale (Grimshaw 1993)."""
    y = np.asarray(excess, dtype=float)
    top, mean = float(y.max()), float(y.mean())

    def loss(theta: float) -> float:
        if abs(theta) < 1e-9 / mean:
            return math.log(mean) + 1
        z = 1 + theta * y
        if z.min() <= 0:
            return math.inf
        k = float(np.log(z).mean())
        return math.inf if k / theta <= 0 else math.log(k / theta) + k + 1

    grid = np.concatenate([-(1 - np.geomspace(1e-6, 1, 200)[:-1]) / top, [0.0], np.geomspace(1e-4, 50, 300) / mean])
    grid = np.unique(grid)
    values = [loss(g) for g in grid]
    k = int(np.argmin(values))
    lo, hi = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(100):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    theta = (lo + hi) / 2
    if abs(theta) < 1e-9 / mean:
        return 0.0, mean
    xi = float(np.log1p(theta * y).mean())
    return xi, xi / theta


def declustered(at: np.ndarray, value: np.ndarray, distance: int) -> np.ndarray:
    """Which of the peaks (index, height) stay when the highest first remove all others under `distance` away; of equal heights the later goes first."""
    keep = np.ones(len(at), dtype=bool)
    for i in np.argsort(value, kind="stable")[::-1]:
        if keep[i]:
            lo, hi = np.searchsorted(at, at[i] - distance, side="right"), np.searchsorted(at, at[i] + distance, side="left")
            keep[lo:hi] = False
            keep[i] = True
    return keep


def block_resample(x: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    """A moving-block resample of the same size."""
    n = len(x)
    length = max(1, min(length, n))
    starts = rng.integers(0, n - length + 1, size=math.ceil(n / length))
    return x[(starts[:, None] + np.arange(length)).ravel()[:n]]


def replicates_for(n: int) -> int:
    """How many resamples of n values an interval takes: fewer for long records."""
    return 200 if n >= 500_000 else 500 if n >= 50_000 else 1000


# --- regimes and clusters ---------------------------------------------------


def gaussian_mixture(x: np.ndarray, k: int, starts: int = 5, rounds: int = 200, seed: int = 1) -> tuple[np.ndarray, float]:
    """(component of each row by rising mean of the first column, log likelihood): the best of several mixtures of full covariance by EM."""
    n, d = x.shape
    floor = 1e-6 * np.eye(d)
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for start in range(starts):
        rng = np.random.default_rng([seed, start])
        # the first start cuts the first column's order into equal parts, the others draw their centres
        order = np.argsort(x[:, 0], kind="stable") if start == 0 else rng.permutation(n)
        centres = np.stack([x[part].mean(axis=0) for part in np.array_split(order, k)]) if start == 0 else x[order[:k]]
        share = np.zeros((n, k))
        share[np.arange(n), ((x[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)] = 1.0
        before = -math.inf
        for _ in range(rounds):
            weight = share.sum(axis=0) + 1e-10
            mean = share.T @ x / weight[:, None]
            logs = np.empty((n, k))
            for j in range(k):
                e = x - mean[j]
                cov = (share[:, j, None] * e).T @ e / weight[j] + floor
                low = np.linalg.cholesky(cov)
                z = np.linalg.solve(low, e.T)
                logs[:, j] = math.log(weight[j] / n) - (z * z).sum(axis=0) / 2 - np.log(np.diag(low)).sum() - d / 2 * math.log(2 * math.pi)
            top = logs.max(axis=1, keepdims=True)
            share = np.exp(logs - top)
            total = share.sum(axis=1, keepdims=True)
            share /= total
            now = float((top[:, 0] + np.log(total[:, 0])).sum())
            if now - before < 1e-6 * n * 1e-2:
                break
            before = now
        if best is None or now > best[0]:
            best = (now, share.argmax(axis=1), mean)
    place = np.empty(k, dtype=int)
    place[np.argsort(best[2][:, 0], kind="stable")] = np.arange(k)
    return place[best[1]], best[0]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 100) -> np.ndarray:
    """Bias and slopes of a logistic regression by Newton steps; the ridge penalty is on slopes only, for the mean loss."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    ridge = penalty * np.diag([0.0, *np.ones(x.shape[1])])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge + 1e-12 * np.eye(len(w))
        step = np.linalg.solve(hessian, a.T @ (p - y) / len(y) + ridge @ w)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < 1e-10:
            break
    return w


def gaussian_hmm(x: np.ndarray, lengths: list[int], states: int = 4, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(means, variances, transitions, most likely states), states by rising mean: Baum-Welch over segments, Viterbi path."""
    rng = np.random.default_rng(seed)
    mean = np.quantile(x, (np.arange(states) + 0.5) / states) + 1e-6 * rng.standard_normal(states)
    var = np.full(states, max(float(x.var()) / states, 1e-6))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    start = np.full(states, 1 / states)
    ends = np.cumsum(lengths)
    last = -math.inf
    for _ in range(rounds):
        density = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
        gamma = np.empty_like(density)
        moves, first, total = np.zeros_like(move), np.zeros(states), 0.0
        for b, n in zip(ends, lengths):
            d = density[b - n : b]
            alpha, scale = np.empty_like(d), np.empty(n)
            a = start * d[0]
            for t in range(n):
                if t:
                    a = (alpha[t - 1] @ move) * d[t]
                scale[t] = a.sum()
                alpha[t] = a / scale[t]
            beta = np.ones_like(d)
            for t in range(n - 2, -1, -1):
                beta[t] = move @ (d[t + 1] * beta[t + 1]) / scale[t + 1]
            g = alpha * beta
            gamma[b - n : b] = g / g.sum(axis=1, keepdims=True)
            if n > 1:
                moves += move * (alpha[:-1].T @ (d[1:] * beta[1:] / scale[1:, None]))
            first += gamma[b - n]
            total += float(np.log(scale).sum())
        start = first / first.sum()
        move = (moves + 1e-12) / (moves + 1e-12).sum(axis=1, keepdims=True)
        weight = gamma.sum(axis=0) + 1e-12
        mean = (gamma * x[:, None]).sum(axis=0) / weight
        var = np.maximum((gamma * (x[:, None] - mean) ** 2).sum(axis=0) / weight, 1e-6)
        if total - last < 1e-2:
            break
        last = total
    order = np.argsort(mean)
    mean, var, move, start = mean[order], var[order], move[np.ix_(order, order)], start[order]
    log_d = -0.5 * (x[:, None] - mean) ** 2 / var - 0.5 * np.log(2 * np.pi * var)
    path = np.empty(len(x), dtype=int)
    log_move = np.log(move)
    for b, n in zip(ends, lengths):
        score, back = np.log(start + 1e-300) + log_d[b - n], np.zeros((n, states), dtype=int)
        for t in range(1, n):
            options = score[:, None] + log_move
            back[t] = options.argmax(axis=0)
            score = options.max(axis=0) + log_d[b - n + t]
        path[b - 1] = score.argmax()
        for t in range(n - 1, 0, -1):
            path[b - n + t - 1] = back[t, path[b - n + t]]
    return mean, var, move, path


def average_linkage(distance: np.ndarray, clusters: int) -> np.ndarray:
    """Cluster numbers from 1 of a distance matrix, merged by average distance until `clusters` are left."""
    groups = [[i] for i in range(len(distance))]
    while len(groups) > clusters:
        best = min(((distance[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        groups[best[1]] += groups.pop(best[2])
    out = np.empty(len(distance), dtype=int)
    for k, g in enumerate(sorted(groups, key=min), 1):
        out[g] = k
    return out


def silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette with Euclidean distances."""
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() < 2:
            scores.append(0.0)
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, labels == other].mean() for other in set(labels) - {own})
        scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(scores))


# --- forecasting ------------------------------------------------------------


def arma_css(y: np.ndarray, p: int, q: int, exog: np.ndarray | None = None) -> dict:
    """ARMA(p, q) with a mean (and regressors) by conditional least squares from a Hannan-Rissanen start.

    Gives const, ar, ma, beta, sigma2, aic and the residuals.
    """
    n = len(y)
    x = np.ones((n, 1)) if exog is None else np.column_stack([np.ones(n), exog])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    z = y - x @ beta
    m = min(max(10, 2 * (p + q)), max(1, n // 4))
    lagged = lambda v, k: np.column_stack([v[k - j - 1 : n - j - 1] for j in range(k)])
    ar, ma = np.zeros(p), np.zeros(q)
    if p + q:
        long = np.linalg.lstsq(lagged(z, m), z[m:], rcond=None)[0]
        e = np.concatenate([np.zeros(m), z[m:] - lagged(z, m) @ long])
        k = max(p, q)
        columns = [z[m + k - j - 1 : n - j - 1] for j in range(p)] + [e[m + k - j - 1 : n - j - 1] for j in range(q)]
        first = np.linalg.lstsq(np.column_stack(columns), z[m + k :], rcond=None)[0]
        ar, ma = first[:p], first[p:]

    def residuals(v: np.ndarray) -> np.ndarray:
        return arma_residuals(y - x @ v[p + q :], v[:p], v[p : p + q])

    def loss(v: np.ndarray) -> float:
        with np.errstate(over="ignore", invalid="ignore"):
            e = residuals(v)
            s = float(e @ e)
        return s if math.isfinite(s) and _stable(v[:p]) and _stable(-v[p : p + q]) else 1e300

    v = np.concatenate([ar, ma, beta])
    if loss(v) >= 1e300:
        v = np.concatenate([ar * 0.5, ma * 0, beta])
    v, value = nelder_mead(loss, v, 0.1, 250) if p + q else (v, loss(v))
    sigma2 = value / n
    return {"ar": v[:p], "ma": v[p : p + q], "beta": v[p + q :], "sigma2": sigma2, "aic": n * (math.log(2 * math.pi * max(sigma2, 1e-300)) + 1) + 2 * (len(v) + 1), "residuals": residuals(v)}


def _stable(phi: np.ndarray) -> bool:
    if not len(phi):
        return True
    return bool((np.abs(np.roots(np.concatenate([[1.0], -phi]))) < 0.9999).all())


def arma_residuals(z: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """One-step errors of a series without mean; errors before it are 0."""
    p, q, n = len(ar), len(ma), len(z)
    base = z.astype(float).copy()
    for j in range(p):
        base[j + 1 :] -= ar[j] * z[: n - j - 1]
    if not q:
        return base
    e = base.tolist()
    m = ma.tolist()
    for t in range(1, n):
        s = 0.0
        for j in range(min(q, t)):
            s += m[j] * e[t - j - 1]
        e[t] -= s
    return np.array(e)


def arma_forecast(z: np.ndarray, ar: np.ndarray, ma: np.ndarray, horizon: int) -> np.ndarray:
    """Forecasts of a series without mean at 1..horizon."""
    e = arma_residuals(z, ar, ma)
    values, errors = z.tolist(), e.tolist()
    for _ in range(horizon):
        s = sum(a * values[-j - 1] for j, a in enumerate(ar) if j < len(values))
        s += sum(m * errors[-j - 1] for j, m in enumerate(ma) if j < len(errors))
        values.append(s)
        errors.append(0.0)
    return np.array(values[len(z) :])


def psi_weights(ar: np.ndarray, ma: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    out[0] = 1.0
    for k in range(1, n):
        out[k] = (ma[k - 1] if k <= len(ma) else 0.0) + sum(ar[j] * out[k - j - 1] for j in range(min(len(ar), k)))
    return out


def garch_fit(e: np.ndarray) -> tuple[float, float, float]:
    """(omega, alpha, beta) of GARCH(1,1) with mean 0, by likelihood."""
    var = float(np.var(e))

    def unpack(v: np.ndarray) -> tuple[float, float, float]:
        total = 0.9999 / (1 + math.exp(-v[1]))
        share = 1 / (1 + math.exp(-v[2]))
        return math.exp(v[0]) * var, total * share, total * (1 - share)

    def loss(v: np.ndarray) -> float:
        w, a, b = unpack(np.clip(v, -20, 20))
        h = garch_variance(e, w, a, b, var)
        return 0.5 * float((np.log(h) + e * e / h).sum())

    best, _ = nelder_mead(loss, np.array([math.log(0.05), 2.5, -2.0]), 0.3, 300)
    return unpack(np.clip(best, -20, 20))


def garch_variance(e: np.ndarray, omega: float, alpha: float, beta: float, start: float) -> np.ndarray:
    out = np.empty(len(e))
    h = start
    squares = (e * e).tolist()
    for t in range(len(e)):
        out[t] = h
        h = omega + alpha * squares[t] + beta * h
    return np.maximum(out, 1e-12)


def garch_forecast(last: float, omega: float, alpha: float, beta: float, horizon: int) -> np.ndarray:
    """Variances at 1..horizon from the next step's variance; linear in the horizon near a unit root."""
    s = alpha + beta
    h = np.arange(horizon)
    if abs(1 - s) < 1e-6:
        return last + h * omega
    level = omega / (1 - s)
    return level + s**h * (last - level)


def error_variance(psi: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Forecast error variance at each horizon: squared psi weights against the variances in reverse."""
    return np.array([float((psi[: h + 1] ** 2 * variances[h::-1]).sum()) for h in range(len(variances))])


