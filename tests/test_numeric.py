"""Recovery of known parameters by the estimators."""

import math

import numpy as np
import pytest

from driftline.functions import numeric as N
from driftline.functions import special as S


def test_tails():
    assert S.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert S.f_tail(4.0, 2, 30) == pytest.approx(0.02884462, abs=1e-7)
    assert S.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_periods_are_found():
    t = np.arange(1200.0)
    assert N.dominant_period(np.sin(2 * np.pi * t / 12), 1.0, 8, 20) == pytest.approx(12.0)
    design = N.harmonic_design(t, [(12.42, 1)])
    beta = np.linalg.lstsq(design, 3 + np.cos(2 * np.pi * t / 12.42), rcond=None)[0]
    assert beta == pytest.approx([3, 1, 0], abs=1e-9)


def test_autoregression():
    rng = np.random.default_rng(3)
    e = rng.standard_normal(6000)
    y = np.zeros(6000)
    for k in range(1, 6000):
        y[k] = 0.7 * y[k - 1] + e[k] + 0.3 * e[k - 1]
    m = N.arma_css(y, 1, 1)
    assert m["ar"][0] == pytest.approx(0.7, abs=0.05) and m["ma"][0] == pytest.approx(0.3, abs=0.06)
    assert N.adf(y)[1] < 0.01 and N.adf(np.cumsum(e))[1] > 0.05
    assert N.kpss(np.cumsum(e))[1] == 0.01
    x = np.zeros(20000)
    e = rng.standard_normal(20000)
    for k in range(1, 20000):
        x[k] = 0.8 * x[k - 1] + e[k]
    tau, _, ceiling = N.integral_timescale(x, 1.0)
    assert tau == pytest.approx((1 + 0.8) / (1 - 0.8), rel=0.25) and not ceiling


def test_trend_and_change_points():
    rng = np.random.default_rng(4)
    t = np.arange(30.0)
    up = N.mann_kendall(0.02 * t + rng.normal(0, 0.02, 30), t)
    assert up["verdict"] == "increasing" and up["sen_slope"] == pytest.approx(0.02, abs=0.005)
    assert N.mann_kendall(t[:5], t[:5])["verdict"] == "too_short"
    x = np.concatenate([np.zeros(60), np.ones(60)]) + rng.normal(0, 0.1, 120)
    for m in (0.5, 1, 2, 4):
        assert N.pelt(x, m * x.var() * math.log(120)) == [60]


def test_extremes_and_distributions():
    rng = np.random.default_rng(5)
    xi, sigma = N.gpd_fit(0.5 / 0.2 * (rng.random(20000) ** -0.2 - 1))
    assert xi == pytest.approx(0.2, abs=0.03) and sigma == pytest.approx(0.5, abs=0.02)
    x = 2 * rng.weibull(1.7, 20000)
    assert N.weibull_moments(x) == pytest.approx((1.7, 2.0), abs=0.05)
    for name in ("rayleigh", "weibull", "lognormal"):
        p, _ = N.fit_distribution(x[:2000], name)
        assert N.distribution_cdf(N.distribution_ppf(np.array([0.2, 0.9]), name, p), name, p) == pytest.approx([0.2, 0.9], abs=1e-6)
    assert N.declustered(np.array([0, 2, 10]), np.array([1.0, 3.0, 2.0]), 5).tolist() == [False, True, True]


def test_volatility():
    assert N.garch_forecast(1.0, 0.1, 0.2, 0.8, 4) == pytest.approx([1.0, 1.1, 1.2, 1.3])
    psi = N.psi_weights(np.array([0.5]), np.array([]), 3)
    assert psi == pytest.approx([1, 0.5, 0.25])
    assert N.error_variance(psi, np.ones(3)) == pytest.approx([1, 1.25, 1.3125])


def test_decompositions():
    t = np.arange(600.0)
    parts, share = N.ssa(np.sin(2 * np.pi * t / 12.42) + 0.4 * np.sin(2 * np.pi * t / 30), 200, 4)
    assert abs(N.w_correlation(parts)[0, 2]) < 0.05 and share[:2].sum() > 0.7
    m = np.arange(120.0)
    trend, season, rest = N.stl(np.sin(2 * np.pi * m / 12) + 0.01 * m)
    assert np.abs(rest).max() < 0.05 and season.max() == pytest.approx(1.0, abs=0.05)


def test_hidden_states():
    rng = np.random.default_rng(6)
    x = np.repeat([0.0, 5.0] * 10, 50) + rng.normal(0, 0.5, 1000)
    mean, _, move, path = N.gaussian_hmm(x, [400, 600], 2)
    assert mean == pytest.approx([0, 5], abs=0.1)
    assert 1 / (1 - move[0, 0]) == pytest.approx(50, rel=0.25)
    assert path[:50].sum() == 0


def test_clusters():
    points = np.concatenate([np.zeros((5, 2)), np.full((5, 2), 9.0)]) + np.random.default_rng(1).normal(0, 0.1, (10, 2))
    labels = np.repeat([0, 1], 5)
    assert N.silhouette(points, labels) > 0.95
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    assert N.average_linkage(d, 2).tolist() == [1] * 5 + [2] * 5
