"""Whole queries without SQL against independent versions in plain numpy: other algorithms on the same rows, at stated tolerances."""

import math

import numpy as np
import pandas as pd
import pytest

from driftline import queries
from driftline.plans import stat_queries as Q


def frame(df, *order):
    out = df.toPandas()
    return out.sort_values(list(order)).reset_index(drop=True) if order else out


@pytest.fixture(scope="module")
def run(spark, data):
    return lambda name: queries.QUERIES[name](spark, data)


@pytest.fixture(scope="module")
def longest(spark, data):
    got = frame(Q._longest(spark, data), "series_id", "idx")
    return {k: g["value"].to_numpy() for k, g in got.groupby("series_id")}


@pytest.fixture(scope="module")
def values(spark, data):
    got = frame(Q.events(spark, data), "series_id", "ts")
    return {k: g["value"].to_numpy() for k, g in got.groupby("series_id")}


def test_singular_spectrum_by_svd(run, longest):
    """Shares to 1e-8, w-correlations to 1e-5, by the singular value decomposition of the trajectory matrix and plain diagonal sums."""
    got, window = frame(run("singular_spectrum"), "series_id", "component"), 24
    for name, rows in got.groupby("series_id"):
        x = longest[name]
        k = len(x) - window + 1
        hankel = np.array([x[i : i + window] for i in range(k)])
        u, s, vt = np.linalg.svd(hankel, full_matrices=False)
        assert rows["share"].to_numpy() == pytest.approx((s**2 / (s**2).sum())[:6], abs=1e-8)
        parts = []
        for c in range(6):
            m = s[c] * np.outer(u[:, c], vt[c])
            parts.append(np.array([np.mean([m[i, t - i] for i in range(max(0, t - window + 1), min(k, t + 1))]) for t in range(len(x))]))
        weight = np.array([min(t + 1, len(x) - t) for t in range(len(x))], dtype=float)
        for i, r in enumerate(rows.itertuples()):
            other = [abs((weight * parts[i] * p).sum()) / math.sqrt((weight * parts[i] ** 2).sum() * (weight * p**2).sum()) if j != i else 0 for j, p in enumerate(parts)]
            assert r.w_correlation == pytest.approx(max(other), abs=1e-5) and r.partner == int(np.argmax(other)) + 1


def slow_loess(x, y, at, span, weight):
    near = sorted(range(len(x)), key=lambda i: abs(x[i] - at))[: min(span, len(x))]
    h = max(abs(x[i] - at) for i in near) * (span / len(x) if span > len(x) else 1.0)
    w = [max(0.0, 1 - (abs(x[i] - at) / max(h, 1e-12) * 0.999999) ** 3) ** 3 * weight[i] for i in range(len(x))]
    a = np.polyfit(np.array(x) - at, y, 1, w=np.sqrt(w)) if sum(v > 0 for v in w) > 1 else [0, np.average(y, weights=w)]
    return a[1]


def test_seasonal_decomposition_by_hand(run):
    """Robust STL with local fits by weighted polynomial least squares, to 1e-4 of the values' spread; shares follow."""
    got = frame(run("seasonal_decomposition"), "series_id", "idx")
    shares = frame(run("seasonal_shares"), "series_id").set_index("series_id")
    for name, rows in got.groupby("series_id"):
        y = rows["value"].to_numpy()
        assert np.allclose(y, rows["trend"] + rows["seasonal"] + rows["residual"], atol=1e-6)
        s = shares.loc[name]
        for c in ("trend", "seasonal", "residual"):
            assert s[f"{c}_share"] == pytest.approx(rows[c].var(ddof=1) / y.var(ddof=1))
        assert s["amplitude"] == pytest.approx((rows["seasonal"].max() - rows["seasonal"].min()) / 2)
    name = got["series_id"].iloc[0]
    y = got[got["series_id"] == name]["value"].to_numpy()
    n, period, span = len(y), 12, 23
    trend, weight, t = np.zeros(n), np.ones(n), list(range(n))
    for _ in range(15):
        for _ in range(2):
            cycle = np.empty(n + 2 * period)
            for p in range(period):
                at = list(range(p, n, period))
                sub = [(y - trend)[i] for i in at]
                for j in range(-1, len(at) + 1):
                    cycle[p + (j + 1) * period] = slow_loess(list(range(len(at))), sub, j, 7, [weight[i] for i in at])
            low = pd.Series(cycle).rolling(period).mean().rolling(period).mean().rolling(3).mean().dropna().to_numpy()
            low = np.array([slow_loess(t, low, i, 13, [1.0] * n) for i in t])
            season = cycle[period : period + n] - low
            trend = np.array([slow_loess(t, y - season, i, span, weight) for i in t])
        rest = np.abs(y - trend - season)
        weight = np.maximum((1 - np.clip(rest / (6 * np.median(rest)), 0, 1) ** 2) ** 2, 1e-9)
    own = got[got["series_id"] == name]
    assert np.allclose(own["trend"], trend, atol=1e-4 * y.std()) and np.allclose(own["seasonal"], season, atol=1e-4 * y.std())


def log_likelihood(name, x, shape, loc, scale):
    y = (x - loc) / scale
    if (y <= 0).any():
        return -math.inf
    if name == "rayleigh":
        return float((np.log(y) - y * y / 2 - math.log(scale)).sum())
    if name == "weibull":
        return float((math.log(shape) + (shape - 1) * np.log(y) - y**shape - math.log(scale)).sum())
    return float((-np.log(y) ** 2 / (2 * shape**2) - np.log(y * shape * math.sqrt(2 * math.pi) * scale)).sum())


def test_distribution_fits_are_of_highest_likelihood(run, values):
    """No neighbour of a fit on a grid of parameters is likelier by more than 0.02; distances to 1e-9; readings name the nearest."""
    got = frame(run("distribution_fits"), "series_id", "name")
    pairs = frame(run("quantile_pairs"), "series_id", "i")
    readings = frame(run("distribution_readings")).set_index("series_id")
    for r in got.itertuples():
        x = np.sort(values[r.series_id][values[r.series_id] > 0])
        top = log_likelihood(r.name, x, r.shape, r.location, r.scale)
        for a in (0.97, 0.99, 1, 1.01, 1.03):
            for b in (0.97, 0.99, 1, 1.01, 1.03):
                for d in (-0.05, -0.01, 0, 0.01, 0.05):
                    assert log_likelihood(r.name, x, r.shape * (a if r.name != "rayleigh" else 1), r.location + d * (x.min() - r.location), r.scale * b) <= top + 0.02
        f = np.array([1 - math.exp(-(((v - r.location) / r.scale) ** 2) / 2) if r.name == "rayleigh" else 1 - math.exp(-(((v - r.location) / r.scale) ** r.shape)) if r.name == "weibull" else 0.5 * math.erfc(-math.log((v - r.location) / r.scale) / r.shape / math.sqrt(2)) for v in x])
        n = len(x)
        d = max(max((i + 1) / n - v, v - i / n) for i, v in enumerate(f))
        assert r.ks == pytest.approx(d, abs=1e-6)
        assert r.p == pytest.approx(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * d * d * n) for k in range(1, 101)))), abs=0.05)
        if r.name == "weibull":
            q = pairs[pairs["series_id"] == r.series_id]
            assert np.allclose(q["observed"], x)
            assert np.allclose(q["expected"], [r.location + r.scale * (-math.log(1 - (i + 0.5) / n)) ** (1 / r.shape) for i in range(n)])
    for name, rows in got.groupby("series_id"):
        assert rows[rows["best"]]["name"].iloc[0] == rows.loc[rows["ks"].idxmin(), "name"] == readings.loc[name, "name"]


def weibull_by_grid(mean, cv):
    k = np.geomspace(0.05, 50, 200_001)
    lg = np.vectorize(math.lgamma)
    lo, hi = 0, len(k) - 1
    while hi - lo > 1:  # the coefficient of variation falls with the shape
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if math.sqrt(math.exp(lg(1 + 2 / k[mid]) - 2 * lg(1 + 1 / k[mid])) - 1) > cv else (lo, mid)
    return k[lo], mean / math.gamma(1 + 1 / k[lo])


def blocks(x, length, rng):
    at = rng.integers(0, len(x) - length + 1, -(-len(x) // length))
    return np.concatenate([x[a : a + length] for a in at])[: len(x)]


def test_resampled_intervals_against_another_draw(run, values):
    """Percentile intervals of another 400 block resamples: ends within 30 % of an interval's width."""
    got = frame(run("resampled_intervals"), "series_id", "statistic").set_index(["series_id", "statistic"])
    for name, x in values.items():
        rng = np.random.default_rng(99)
        draws = {k: [] for k in ("mean", "p50", "p90", "p95", "weibull_shape", "weibull_scale")}
        for _ in range(400):
            y = blocks(x, 24, rng)
            shape, scale = weibull_by_grid(y[y > 0].mean(), y[y > 0].std() / y[y > 0].mean())
            for k, v in zip(draws, (y.mean(), *np.percentile(y, (50, 90, 95)), shape, scale)):
                draws[k].append(v)
        for k, v in draws.items():
            low, high = np.percentile(v, (2.5, 97.5))
            r = got.loc[(name, k)]
            assert abs(r["low"] - low) < 0.3 * (high - low) and abs(r["high"] - high) < 0.3 * (high - low)


def test_weibull_band_against_another_draw(run, values):
    got = frame(run("weibull_band"), "series_id", "x")
    assert got.groupby("series_id").size().eq(200).all() and (got["low"] <= got["high"]).all()
    for name, rows in got.groupby("series_id"):
        x, rng = values[name], np.random.default_rng(5)
        assert rows["x"].max() == pytest.approx(1.2 * x.max())
        fits = []
        for _ in range(300):
            y = blocks(x, 24, rng)
            fits.append(weibull_by_grid(y[y > 0].mean(), y[y > 0].std() / y[y > 0].mean()))
        at = rows["x"].to_numpy()[40]
        low, high = np.percentile([k / c * (at / c) ** (k - 1) * math.exp(-((at / c) ** k)) for k, c in fits], (2.5, 97.5))
        r = rows.iloc[40]
        assert abs(r["low"] - low) < 0.35 * (high - low) and abs(r["high"] - high) < 0.35 * (high - low) and r["low"] < r["density"] < r["high"]


def test_extreme_intervals_hold_the_fit(run):
    fits = frame(run("extreme_fits")).set_index("series_id")
    for r in frame(run("extreme_intervals")).itertuples():
        assert r.low < fits.loc[r.series_id, "xi"] + 0.01 and r.high > fits.loc[r.series_id, "xi"] - 0.01 and r.low < r.high and r.failed >= 0


def test_regime_shares_by_hand(run, values):
    got = frame(run("regime_shares"), "series_id", "label")
    for name, rows in got.groupby("series_id"):
        x = values[name]
        label = np.where(x > 60, 2, np.where(x > 20, 1, 0))
        for r in rows.itertuples():
            assert r.share == pytest.approx((label == r.label).mean())
            assert pd.isna(r.low) or 0 <= r.low <= r.high <= 1


def mixture_likelihood(x, labels, k):
    """Log likelihood of the mixture that EM reaches from given labels, one value at a time."""
    share = np.eye(k)[labels]
    for _ in range(400):
        w = share.sum(axis=0) + 1e-10
        mean = (share * x[:, None]).sum(axis=0) / w
        var = (share * (x[:, None] - mean) ** 2).sum(axis=0) / w + 1e-6
        d = w / len(x) * np.exp(-((x[:, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var)
        share = d / d.sum(axis=1, keepdims=True)
    return np.log(d.sum(axis=1)).sum()


def test_regimes_are_the_best_mixture_found(run, values):
    """Shares and means of each regime from the labels; EM from quantile cuts finds no likelier mixture by more than 1 %."""
    from driftline.functions.numeric import gaussian_mixture

    got = frame(run("regimes"), "series_id", "regime")
    for name, rows in got.groupby("series_id"):
        x = values[name]
        assert rows["n"].sum() == len(x) and rows["mean"].is_monotonic_increasing
        assert (rows["n"] * rows["mean"]).sum() == pytest.approx(x.sum())
        z = ((x - x.mean()) / x.std())[:, None]
        labels, top = gaussian_mixture(z, 4)
        for r in rows.itertuples():
            assert r.n == (labels == r.regime).sum() and r.mean == pytest.approx(x[labels == r.regime].mean())
        cuts = np.searchsorted(np.quantile(x, (0.4, 0.7, 0.9)), x)
        assert top >= mixture_likelihood(z[:, 0], cuts, 4) - 0.01 * abs(top)


def test_hidden_regimes_by_forward_sums(run, spark, data):
    """The chain's own shares: rows of its transition matrix sum to 1, dwell times follow, states in order of their means."""
    got = frame(run("hidden_regimes"), "series_id", "state")
    for _, rows in got.groupby("series_id"):
        moves = np.stack(rows["moves"])
        assert np.allclose(moves.sum(axis=1), 1) and rows["mean"].is_monotonic_increasing and rows["share"].sum() == pytest.approx(1)
        assert np.allclose(rows["stay"], np.diag(moves)) and np.allclose(rows["dwell_hours"], 1 / np.maximum(1 - np.diag(moves), 1e-12))


def test_components_by_eigenvalues(run, spark, data):
    x = spark.read.parquet(f"{data}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount", "l_tax").toPandas().astype(float)
    u, s, vt = np.linalg.svd((x - x.mean()) / x.std(ddof=0), full_matrices=False)
    got = frame(run("components"))
    for k, rows in got.groupby("component"):
        assert rows["share"].iloc[0] == pytest.approx(s[k - 1] ** 2 / (s**2).sum(), rel=1e-8)
        v = dict(zip(x.columns, vt[k - 1] * np.sign(vt[k - 1][np.abs(vt[k - 1]).argmax()])))
        assert {r.variable: pytest.approx(v[r.variable], abs=1e-6) for r in rows.itertuples()} == {r.variable: r.loading for r in rows.itertuples()}


def test_fingerprints_by_brute_force(run, spark, data):
    got = frame(run("fingerprints"), "series_id")
    c = spark.read.parquet(f"{data}/customer.parquet").toPandas()
    by = c.groupby("c_nationkey")["c_acctbal"].agg(["mean", "std", "count"]).astype(float)
    by = by.fillna(by.mean()).fillna(0)
    z = ((by - by.mean()) / by.std(ddof=0)).loc[got["series_id"]].to_numpy()
    label = got["cluster"].to_numpy()
    total = []
    for i in range(len(z)):
        far = [math.dist(z[i], z[j]) for j in range(len(z))]
        mean = lambda g: np.mean([far[j] for j in range(len(z)) if label[j] == g and j != i]) if any(label[j] == g and j != i for j in range(len(z))) else None  # noqa: E731, B023
        a, b = mean(label[i]), min(mean(g) for g in set(label) - {label[i]})
        total.append(0 if a is None else (b - a) / max(a, b))
    assert got["silhouette"].iloc[0] == pytest.approx(np.mean(total)) and got["k"].iloc[0] == len(set(label))
    centres = {g: z[label == g].mean(axis=0) for g in set(label)}
    assert all(min(centres, key=lambda g: math.dist(z[i], centres[g])) == label[i] for i in range(len(z)))
    flat = got[["pc1", "pc2"]].to_numpy()
    s = np.linalg.svd(z - z.mean(axis=0), compute_uv=False)
    assert np.allclose(flat.var(axis=0), s[:2] ** 2 / len(z))


def test_station_clusters_by_merging_pairs(run, spark, data):
    """Average linkage by updating pairwise averages (Lance and Williams)."""
    from driftline.operators import stats

    pairs = stats.pairwise_correlation(Q._nation_days(spark, data)).select("a", "b", "r").collect()
    got = frame(run("station_clusters"))
    names = sorted({r["a"] for r in pairs} | {r["b"] for r in pairs})
    d = {frozenset(p): 1.0 for p in ((a, b) for a in names for b in names if a < b)}
    for r in pairs:
        d[frozenset((r["a"], r["b"]))] = 1 - (r["r"] if r["r"] is not None else 0.0)
    groups = {a: {a} for a in names}
    while len(groups) > 4:
        a, b = min(d, key=lambda p: (round(d[p], 12), min(p), max(p)))
        a, b = min(a, b), max(a, b)
        for c in groups:
            if c not in (a, b):
                d[frozenset((a, c))] = (len(groups[a]) * d[frozenset((a, c))] + len(groups[b]) * d.pop(frozenset((b, c)))) / (len(groups[a]) + len(groups[b]))
        d.pop(frozenset((a, b)))
        groups[a] |= groups.pop(b)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g["series_id"]) for _, g in got.groupby("cluster"))


def descend(x, y, penalty):
    """Logistic regression by plain gradient steps."""
    sd, mean = x.std(axis=0), x.mean(axis=0)
    z = (x - mean) / sd
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        w -= 0.5 * (z.T @ (p - y) / len(y) + penalty * w / sd**2)
        b -= 0.5 * (p - y).mean()
    return lambda v: 1 / (1 + np.exp(-((v - mean) / sd @ w + b)))


@pytest.mark.parametrize("name, driven", [("exceedance_forecast", False), ("exceedance_deltas", True)])
def test_exceedance_models_by_gradient_descent(run, spark, data, name, driven):
    """Brier scores (skills) of each series to 1e-3."""
    from driftline.operators import windows

    rows = Q._indexed(spark, data)
    g = frame(windows.exceedance_features(rows), "series_id", "idx")
    drive = g[g["series_id"] == "view"].set_index("us")["value"]
    got = frame(run(name)).set_index("series_id")
    for series, x in g.groupby("series_id"):
        x = x.reset_index(drop=True)
        u = np.nanpercentile(x["value"], 90)
        ahead = [x["value"].iloc[i + 1 : i + 7].max() for i in range(len(x))]
        x["label"] = [np.nan if pd.isna(v) else float(v > u) for v in ahead]
        x["drive"] = x["us"].map(drive)
        x = x[x["value"].notna()]
        if driven:
            x = x[x["label"].notna() & x["drive"].notna()]
        lo, hi = x["idx"].min(), x["idx"].max()
        for cols, column in ((["level", "trend", "volatility"], "skill"), *([(["level", "trend", "volatility", "drive"], "skill_driven")] if driven else [])):
            z = x.dropna(subset=[*cols, "label"])
            early = z["idx"] < lo + 0.55 * (hi - lo)
            if early.sum() < 30 or z[early]["label"].nunique() < 2:
                assert series not in got.index
                continue
            model = descend(z[early][cols].to_numpy(float), z[early]["label"].to_numpy(), 1 / early.sum())
            late = z[~early]
            brier = ((model(late[cols].to_numpy(float)) - late["label"]) ** 2).mean()
            share = late["label"].mean()
            assert got.loc[series, column] == pytest.approx(1 - brier / (share * (1 - share)), abs=2e-3)


def squares(z, ar, ma):
    e = np.zeros(len(z))
    for t in range(len(z)):
        e[t] = z[t] - sum(a * z[t - j - 1] for j, a in enumerate(ar) if t > j) - sum(m * e[t - j - 1] for j, m in enumerate(ma) if t > j)
    return float(e @ e), e


def test_order_search_against_a_grid(run, longest):
    """AIC of AR(1) and ARMA(1, 1) no worse than the best of a fine grid by 0.5; `best` is the least."""
    got = frame(run("order_search"), "series_id", "p", "d", "q")
    for name, rows in got.groupby("series_id"):
        assert rows[rows["best"]]["aic"].iloc[0] == rows["aic"].min() and len(rows) == 15
        z = longest[name][:4000] - longest[name][:4000].mean()
        n = len(z)
        aic = lambda s, k: n * (math.log(2 * math.pi * s / n) + 1) + 2 * (k + 1)  # noqa: E731, B023
        one = min(squares(z, [a], [])[0] for a in np.linspace(-0.95, 0.95, 96))
        assert rows.set_index(["p", "q"]).loc[(1, 0), "aic"] <= aic(one, 2) + 0.5
        both = min(squares(z, [a], [m])[0] for a in np.linspace(-0.9, 0.9, 13) for m in np.linspace(-0.9, 0.9, 13))
        assert rows.set_index(["p", "q"]).loc[(1, 1), "aic"] <= aic(both, 3) + 0.5
        break


def test_backtests_by_recursion(run, longest):
    """Forecasts from fitted parameters by plain recursion; intervals widen with the horizon and agree with interval_quality."""
    from driftline.functions import numeric as N

    got = frame(run("arma_backtest"), "series_id", "origin_idx", "horizon")
    quality = frame(run("interval_quality")).set_index(["series_id", "horizon"])
    garch = frame(run("garch_backtest"), "series_id", "origin_idx", "horizon")
    for name, rows in got.groupby("series_id"):
        y = longest[name]
        m = N.arma_css(y[:100], 1, 1)
        base = min(squares(y[:100] - c, [a], [b])[0] for c in (y[:100].mean(), m["beta"][0]) for a in np.linspace(-0.9, 0.9, 13) for b in np.linspace(-0.9, 0.9, 13))
        assert m["sigma2"] * 100 <= base * 1.01
        a, b, c = m["ar"][0], m["ma"][0], m["beta"][0]
        for r in rows.iloc[:9].itertuples():
            z = y[max(0, r.origin_idx + 1 - 96) : r.origin_idx + 1] - c
            _, e = squares(z, [a], [b])
            ahead = a * z[-1] + b * e[-1]
            assert r.predicted == pytest.approx(c + ahead * a ** (r.horizon - 1), abs=1e-6) and r.actual == y[r.origin_idx + r.horizon]
            psi = [1.0] + [a**k * (1 + b / a) if a else (b if k == 1 else 0.0) for k in range(1, r.horizon)]
            assert r.half_width == pytest.approx(1.959964 * math.sqrt(m["sigma2"] * sum(p * p for p in psi)), rel=1e-5)
        for h, part in rows.groupby("horizon"):
            assert quality.loc[(name, h), "coverage"] == pytest.approx((part["error"].abs() <= part["half_width"]).mean())
            assert quality.loc[(name, h), "mean_width"] == pytest.approx(2 * part["half_width"].mean())
        other = garch[garch["series_id"] == name]
        assert np.allclose(other["predicted"], rows["predicted"]) and (other["half_width"] > 0).all()


def test_driven_backtest_by_least_squares(run, spark, data):
    """AR(1) about a line in the driver: parameters no worse than alternating least squares, forecasts by recursion."""
    from driftline.functions import numeric as N

    got = frame(run("driven_backtest"), "series_id", "origin_idx", "horizon")
    rows = frame(Q._longest(spark, data), "series_id", "idx")
    for name, part in rows.groupby("series_id"):
        y, us = part["value"].to_numpy(), part["us"].to_numpy()
        x = np.sin(us / 3.6e9 * 0.2618)
        lag = np.concatenate([[np.nan], x[:-1]])
        m = N.arma_css(y[1:100], 1, 0, lag[1:100])
        own, phi, line = y[1:100], 0.0, np.zeros(2)
        design = np.column_stack([np.ones(99), lag[1:100]])
        for _ in range(200):
            top, low = own - phi * np.concatenate([[0], own[:-1]]), design - phi * np.vstack([[0, 0], design[:-1]])
            line = np.linalg.lstsq(low, top, rcond=None)[0]
            z = own - design @ line
            phi = (z[1:] @ z[:-1]) / (z[:-1] @ z[:-1])
        z = own - design @ line
        best = z[0] ** 2 + ((z[1:] - phi * z[:-1]) ** 2).sum()
        assert m["sigma2"] * 99 <= best * 1.001
        mine = got[got["series_id"] == name]
        for r in mine.iloc[:6].itertuples():
            known = x[min(r.origin_idx + r.horizon - 1, r.origin_idx)]
            left = y[r.origin_idx] - m["beta"][0] - m["beta"][1] * lag[r.origin_idx]
            assert r.predicted == pytest.approx(m["beta"][0] + m["beta"][1] * known + left * m["ar"][0] ** r.horizon, abs=1e-6)


def test_window_stability_by_hand(run, spark, data):
    from driftline.functions import numeric as N

    got = frame(run("window_stability")).set_index("series_id")
    e = frame(Q.events(spark, data), "series_id", "ts")
    e["us"] = e["ts"].astype("int64") // (1000 if str(e["ts"].dtype).endswith("[ns]") else 1)
    for name, g in e.groupby("series_id"):
        lo, hi = g["us"].min(), g["us"].max()
        part = np.minimum((g["us"] - lo) * 4 // max(hi - lo, 1) + 1, 4)
        names, means = [], []
        for _, x in g.groupby(part):
            v = x["value"].to_numpy()
            if len(v) >= 30:
                v0 = v[v > 0]
                names.append(min(("rayleigh", "weibull", "lognormal"), key=lambda n: N.ks_distance(v0, n, N.fit_distribution(v0, n)[0])[0]))  # noqa: B023
                means.append(v.mean())
        if names:
            assert got.loc[name, "agreement"] == pytest.approx(max(map(names.count, names)) / len(names)) and got.loc[name, "mean_range"] == pytest.approx(max(means) - min(means))


def test_any_forecast_function_over_rolling_origins(spark, data):
    """The last valid value as a forecast function gives the persistence backtest's rows; a mean gives means by hand."""
    from driftline.operators import forecast as FC

    rows = Q._indexed(spark, data)

    def last(x, horizons):
        ok = x[~np.isnan(x)]
        return [ok[-1] if len(ok) else None] * len(horizons)

    columns = ["series_id", "origin_idx", "horizon_samples", "predicted", "error"]
    want = frame(FC.persistence(rows, [1, 3, 6], 5, 24, 3), "series_id", "origin_idx", "horizon_samples")[columns]
    got = frame(FC.rolling_origin(rows, last, [1, 3, 6], 5, 24, 4), "series_id", "origin_idx", "horizon_samples")[columns]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    values = {k: g.sort_values("idx")["value"].to_numpy() for k, g in frame(rows).groupby("series_id")}
    for r in FC.rolling_origin(rows, lambda x, h: [float(np.nanmean(x))] * len(h), [2], 50, 24, 12).collect():
        assert r.predicted == pytest.approx(np.nanmean(values[r.series_id][r.origin_idx - 11 : r.origin_idx + 1]))


def test_chain_by_hand(spark, data, tmp_path, run):
    """Five chained stages against numpy: cleaned grid, least squares residuals, the likeliest power, white-noise statistics, peaks at the dependence's distance."""
    from driftline.functions import numeric as N
    from driftline.plans import chain

    from driftline.plans.series_queries import hourly

    got = chain.run(spark, hourly(spark, data).where("value is not null").select("series_id", "ts", "value"), str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {f"stage={f.__name__}" for f, _ in chain.LINKS}
    grid = frame(got["clean"], "series_id", "ts")
    level, changed = frame(got["notch"], "series_id", "ts"), frame(got["transform"], "series_id", "ts")
    white, depend, tails = frame(got["whiteness"], "series_id", "lag"), frame(got["dependence"]).set_index("series_id"), frame(got["extremes"]).set_index("series_id")
    for name, g in grid.groupby("series_id"):
        g = g.reset_index(drop=True)
        h, y = (g["ts"] - g["ts"].iloc[0]).dt.total_seconds().to_numpy() / 3600, g["value"].to_numpy()
        ok = ~np.isnan(y)
        a = np.column_stack([np.ones(len(h)), *(f(2 * np.pi * k * h / 24) for k in (1, 2) for f in (np.cos, np.sin))])
        own = (y - a @ np.linalg.lstsq(a[ok], y[ok], rcond=None)[0])[ok] + y[ok].mean()
        assert np.allclose(level[level["series_id"] == name]["level"].dropna(), own, atol=1e-6)
        x = own if own.min() > 0 else own - own.min() + 1e-6
        c = changed[changed["series_id"] == name]
        like = lambda lam: (lam - 1) * np.log(x).sum() - len(x) / 2 * math.log(((x**lam - 1) / lam).var())  # noqa: E731, B023
        lam = c["lambda"].iloc[0]
        assert like(lam) >= max(like(v) for v in np.linspace(-2, 3, 501) if abs(v) > 1e-3) - 1e-6
        z = (x**lam - 1) / lam
        z = z - z.mean()
        assert np.allclose(c["residual"], z, atol=1e-6)
        rho = [z[k:] @ z[:-k] / (z @ z) for k in range(1, 49)]
        n = len(z)
        for r in white[white["series_id"] == name].itertuples():
            assert r.lb_q == pytest.approx(n * (n + 2) * sum(rho[k - 1] ** 2 / (n - k) for k in range(1, r.lag + 1)), rel=1e-6)
        if name not in depend.index:  # no stretch of 48 hours
            assert name not in tails.index
            continue
        distance = max(1, math.ceil(depend.loc[name, "decluster_hours"]))
        v = y[ok]
        at = np.array([i for i in range(1, len(v) - 1) if v[i] > v[i - 1] and v[i] > v[i + 1] and v[i] >= np.percentile(v, 90)])
        kept = N.declustered(at, v[at], distance)
        assert tails.loc[name, "n_peaks"] == (v[at[kept]] > np.percentile(v, 90)).sum()
    assert frame(run("chained_whiteness"), "series_id", "lag")["lb_q"].to_numpy() == pytest.approx(white["lb_q"].to_numpy())
    assert frame(run("chained_extremes"), "series_id")["n_peaks"].tolist() == tails.sort_index()["n_peaks"].tolist()


def test_every_query_has_sql_or_a_test():
    """Queries without SQL are those that this module holds against another computation."""
    text = open(__file__).read()
    assert [n for n in queries.QUERIES if n not in queries.ORACLE_SQL and f'"{n}"' not in text] == []
