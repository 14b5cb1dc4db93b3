"""Estimators for each series or segment: numpy routines run by applyInPandas, one group at a time.

These algorithms are sequential along a segment (state recursions, likelihood
searches, tests), so the parallel axis is the number of groups; what can be
summed over rows (moments, Gram sums, spectra of short frequency lists, rank
statistics) is in the other modules as aggregations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N

DISTRIBUTIONS = ("rayleigh", "weibull", "lognormal")
# Tidal and solar periods, in hours.
CONSTITUENTS = (("M2", 12.4206), ("S2", 12.0), ("MS4", 6.1033), ("diurnal", 24.0))


def _valid(pdf: pd.DataFrame, by: str = "ts") -> np.ndarray:
    return pdf.sort_values(by)["value"].dropna().to_numpy(dtype=float)


def per_group(df: DataFrame, keys: list[str], schema: str, rows) -> DataFrame:
    """rows(values in time order, frame) -> list of tuples after the keys, for each group; schema of those tuples."""
    types = dict(df.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    names = [*keys, *(c.split()[0] for c in schema.split(", "))]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows(_valid(pdf), pdf)], columns=names)

    return df.groupBy(*keys).applyInPandas(run, f"{head}, {schema}")


def spectra(df: DataFrame, keys: list[str], dt_hours: float, detrend: str = "linear") -> DataFrame:
    """(keys, frequency, period_hours, power) of each group's valid values in order."""

    def rows(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        if len(x) < 4:
            return []
        f, p = N.periodogram(x, dt_hours, detrend)
        return [(float(a), len(x) * dt_hours / k if k else None, float(b)) for k, (a, b) in enumerate(zip(f, p))]  # whole periods are exact

    return per_group(df, keys, "frequency double, period_hours double, power double", rows)


def peak_over_baseline(spectrum: DataFrame, keys: list[str], centre: float, width: float, base: tuple[float, float], excluded: list[tuple[float, float]]) -> DataFrame:
    """(keys, ratio): the highest power within width of a period over the median power of a band of periods without the excluded ones."""
    p = F.col("period_hours")
    floor = (p > base[0]) & (p < base[1])
    for c, w in excluded:
        floor = floor & ~(F.abs(p - c) < w)
    return spectrum.groupBy(*keys).agg((F.max(F.when(F.abs(p - centre) < width, F.col("power"))) / F.median(F.when(floor, F.col("power")))).alias("ratio"))


def dominant_periods(spectrum: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """(keys, period_hours, constituent): the strongest period in [low, high] and the constituent within a quarter hour of it."""
    best = spectrum.where(F.col("period_hours").between(low, high)).groupBy(*keys).agg(F.max_by("period_hours", F.struct("power", "frequency")).alias("period_hours"))
    named = F.coalesce(*(F.when(F.abs(F.col("period_hours") - p) <= 0.25, F.lit(n)) for n, p in CONSTITUENTS))
    return best.withColumn("constituent", named)


def box_cox(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts, value, transformed, lambda): power transform of highest likelihood of each group; values that are not positive are first shifted."""
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*keys, "ts", "value"]].copy()
        ok = out["value"].notna()
        x = out.loc[ok, "value"].to_numpy(dtype=float)
        out["transformed"], out["lambda"] = np.nan, np.nan
        if len(x) > 2 and x.std() > 0:
            if x.min() <= 0:
                x = x - x.min() + 1e-6
            y, lam = N.boxcox(x)
            out.loc[ok, "transformed"], out["lambda"] = y, lam
        return out

    head = ", ".join(f"{k} {types[k]}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{head}, ts {types['ts']}, value double, transformed double, lambda double")


def ssa(df: DataFrame, keys: list[str], dt_hours: float, window: int = 100, components: int = 6) -> DataFrame:
    """(keys, component, share, period_hours, constituent, partner, w_correlation) of each group's singular spectrum; groups not longer than twice the window are left out."""

    def rows(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        if len(x) <= 2 * window:
            return []
        parts, share = N.ssa(x, window, components)
        corr = np.abs(N.w_correlation(parts))
        np.fill_diagonal(corr, 0)
        out = []
        for k in range(len(parts)):
            f, p = N.periodogram(parts[k], dt_hours, "constant")
            period = float(1 / f[1:][p[1:].argmax()])
            name = next((n for n, c in CONSTITUENTS if abs(period - c) <= 0.25), None)
            out.append((k + 1, float(share[k]), period, name, int(corr[k].argmax()) + 1, float(corr[k].max())))
        return out

    return per_group(df, keys, "component int, share double, period_hours double, constituent string, partner int, w_correlation double", rows)


def stl(df: DataFrame, keys: list[str], period: int = 12) -> DataFrame:
    """(keys, idx, value, trend, seasonal, residual) of each group with two periods or more."""

    def rows(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        if len(x) < 2 * period:
            return []
        return [(i, float(v), float(a), float(b), float(c)) for i, (v, a, b, c) in enumerate(zip(x, *N.stl(x, period)))]

    return per_group(df, keys, "idx int, value double, trend double, seasonal double, residual double", rows)


def variance_shares(decomposed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, trend_share, seasonal_share, residual_share, amplitude, unstable): a share, or their sum, above 1.02 is unstable."""
    whole = F.var_samp("value")
    out = decomposed.groupBy(*keys).agg(*((F.var_samp(c) / whole).alias(f"{c}_share") for c in ("trend", "seasonal", "residual")), ((F.max("seasonal") - F.min("seasonal")) / 2).alias("amplitude"))
    shares = [F.col(f"{c}_share") for c in ("trend", "seasonal", "residual")]
    return out.withColumn("unstable", (F.greatest(*shares) > 1.02) | (shares[0] + shares[1] + shares[2] > 1.02))


def autocorrelations(df: DataFrame, keys: list[str], lags: int = 48) -> DataFrame:
    """(keys, lag, acf, pacf)."""

    def rows(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        k = min(lags, len(x) - 1)
        return [] if k < 1 or x.std() == 0 else [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(N.acf(x, k), N.pacf(x, k)))]

    return per_group(df, keys, "lag int, acf double, pacf double", rows)


def timescales(df: DataFrame, keys: list[str], dt_hours: float, max_lag: int = 2000) -> DataFrame:
    """(keys, n, tau_hours, lag1, cut_lag, hit_ceiling) of each group of three or more values."""

    def rows(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        if len(x) < 3 or x.std() == 0:
            return []
        tau, cut, ceiling = N.integral_timescale(x, dt_hours, max_lag)
        return [(len(x), tau, float(N.acf(x, 1)[1]), cut, ceiling)]

    return per_group(df, keys, "n long, tau_hours double, lag1 double, cut_lag int, hit_ceiling boolean", rows)


def dependence_summary(segment_scales: DataFrame, dt_hours: float) -> DataFrame:
    """(series_id, tau_hours, lag1, block_length, decluster_hours): means of segments weighted by their length."""
    w = F.sum("n")
    out = segment_scales.groupBy("series_id").agg((F.sum(F.col("n") * F.col("tau_hours")) / w).alias("tau_hours"), (F.sum(F.col("n") * F.col("lag1")) / w).alias("lag1"), F.bool_or("hit_ceiling").alias("hit_ceiling"))
    return out.withColumn("block_length", F.greatest(F.lit(1), F.ceil(F.col("tau_hours") / dt_hours)).cast("long")).withColumn("decluster_hours", F.round(2 * F.col("tau_hours"), 1))


def stationarity(df: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """(keys, n, adf, adf_p, kpss, kpss_p, verdict); groups under 20 values are left out."""

    def rows(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        if len(x) < 20 or x.std() == 0:
            return []
        a, ap, _ = N.adf(x)
        k, kp, _ = N.kpss(x)
        verdict = {(True, True): "stationary", (False, False): "non_stationary", (True, False): "difference_stationary", (False, True): "trend_stationary"}[ap < alpha, kp >= alpha]
        return [(len(x), a, ap, k, kp, verdict)]

    return per_group(df, keys, "n long, adf double, adf_p double, kpss double, kpss_p double, verdict string", rows)


def whiteness(df: DataFrame, keys: list[str], lags: tuple[int, ...] = (6, 12, 24, 48)) -> DataFrame:
    """(keys, lag, lb_q, lb_p, lm, lm_p, f, f_p): Ljung-Box and ARCH-LM tests of each group longer than three times the longest lag."""

    def rows(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        if len(x) < 3 * max(lags) or x.std() == 0:
            return []
        return [(k, q, p, *rest) for (k, q, p), (_, *rest) in zip(N.ljung_box(x, lags), N.arch_lm(x - x.mean(), lags))]

    return per_group(df, keys, "lag int, lb_q double, lb_p double, lm double, lm_p double, f double, f_p double", rows)


def change_points(df: DataFrame, keys: list[str], multipliers: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0, 4.0), jump: int = 5) -> DataFrame:
    """(keys, multiplier, break_idx): PELT with squared cost at penalties of multiples of variance times log n."""

    def rows(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        if len(x) < 4:
            return []
        return [(m, b) for m in multipliers for b in N.pelt(x, m * float(x.var()) * np.log(len(x)), jump=jump)]

    return per_group(df, keys, "multiplier double, break_idx int", rows)


def fits(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, shape, location, scale, ks, p, anderson, best) of the candidate distributions on positive values."""

    def rows(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        x = x[x > 0]
        if len(x) < 10 or x.std() == 0:
            return []
        out = []
        for name in DISTRIBUTIONS:
            parameters, _ = N.fit_distribution(x, name)
            d, p = N.ks_distance(x, name, parameters)
            out.append((name, *map(float, parameters), d, p, N.anderson_normal(x)))
        best = min(out, key=lambda r: r[4])[0]
        return [(*r, r[0] == best) for r in out]

    return per_group(df, keys, "name string, shape double, location double, scale double, ks double, p double, anderson double, best boolean", rows)


def qq_points(df: DataFrame, keys: list[str], name: str = "weibull") -> DataFrame:
    """(keys, i, observed, expected): plot data of quantiles against a fitted distribution."""

    def rows(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        x = np.sort(x[x > 0])
        if len(x) < 10:
            return []
        parameters, _ = N.fit_distribution(x, name)
        expected = N.distribution_ppf((np.arange(1, len(x) + 1) - 0.5) / len(x), name, parameters)
        return [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, expected))]

    return per_group(df, keys, "i int, observed double, expected double", rows)


def _settings(threshold: DataFrame) -> list[str]:
    """The columns beside the threshold: the series and, where a series has several thresholds, what tells them apart."""
    return [c for c in threshold.columns if c != "threshold"]


def declustered_peaks(samples: DataFrame, threshold: DataFrame, distance: int | None = None) -> DataFrame:
    """(series_id, ts, peak): local maxima at or above the series' threshold, thinned so that any two are `distance` rows apart, the highest first.

    threshold: series_id, threshold, and for several settings a series further
    columns, which the result has too; one of them is `distance` if that is not
    given here.

    Candidates (rises before and falls after, plateaus by their middle) come
    from window functions; only they meet for the greedy pass. Rows are counted
    after nulls are dropped.
    """
    from .ordered import Ordered, with_micros

    rows = Ordered(with_micros(samples.where("value is not null")), ["series_id"]).index("idx").previous("value", "before")
    rows = rows.running_sum(F.when(F.col("before").isNull() | (F.col("before") != F.col("value")), 1).otherwise(0), "flat").done()
    flats = rows.groupBy("series_id", "flat").agg(F.first("value").alias("value"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.min("us").alias("us"))
    near = Ordered(flats, ["series_id"]).previous("value", "left_").following("value", "right_").done()
    peaks = near.where("value > left_ and value > right_").withColumn("idx", F.floor((F.col("lo") + F.col("hi")) / 2).cast("long"))
    keys = _settings(threshold)
    peaks = peaks.join(threshold, "series_id").where(F.col("value") >= F.col("threshold")).select(*keys, "idx", "value")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        apart = distance if distance is not None else int(pdf["distance"].iloc[0])
        return pdf[N.declustered(pdf["idx"].to_numpy(), pdf["value"].to_numpy(), apart)]

    kept = peaks.groupBy(*keys).applyInPandas(run, peaks.schema)
    return kept.join(rows.select("series_id", "idx", "ts"), ["series_id", "idx"]).select(*keys, "ts", F.col("value").alias("peak"))


def gpd(peaks: DataFrame, threshold: DataFrame) -> DataFrame:
    """(series_id, n_peaks, xi, sigma, ks, p, few): generalised Pareto fit of excesses, for each setting of the thresholds; under 3 peaks no row, under 10 few is true."""
    keys = _settings(threshold)
    excess = peaks.join(threshold, keys).select(*keys, "ts", (F.col("peak") - F.col("threshold")).alias("value"))

    def rows(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        x = x[x > 0]
        if len(x) < 3:
            return []
        xi, sigma = N.gpd_fit(x)
        y = np.sort(x)
        f = 1 - np.exp(-y / sigma) if abs(xi) < 1e-8 else 1 - np.maximum(1 + xi * y / sigma, 0) ** (-1 / xi)
        i = np.arange(1, len(y) + 1)
        d = float(max((i / len(y) - f).max(), (f - (i - 1) / len(y)).max()))
        return [(len(x), float(xi), float(sigma), d, N.kolmogorov_tail(d, len(y)), len(x) < 10)]

    return per_group(excess, keys, "n_peaks long, xi double, sigma double, ks double, p double, few boolean", rows)


def weibull_bootstrap(df: DataFrame, keys: list[str], block: int | None = None, replicates: int | None = None, parts: int = 8, seed: int = 0) -> DataFrame:
    """(keys, statistic, low, high): percentile intervals of mean, p50, p90, p95 and Weibull parameters over moving-block resamples.

    block: length of a block, or without it df's column of that name.
    replicates: by default as many as the number of values asks for. They are
    spread over parts of each series. A statistic that half of the resamples
    or more do not give has no row.
    """
    names = ("mean", "p50", "p90", "p95", "weibull_shape", "weibull_scale")
    spread = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def rows(x: np.ndarray, pdf: pd.DataFrame) -> list[tuple]:
        if len(x) < 10:
            return []
        part = int(pdf["part"].iloc[0])
        length = block if block is not None else int(pdf["block"].iloc[0])
        rng = np.random.default_rng([seed, part])
        out = []
        for _ in range(part, replicates or N.replicates_for(len(x)), parts):
            y = N.block_resample(x, length, rng)
            try:
                fit = N.weibull_moments(y)
            except ValueError:
                fit = (None, None)
            out += list(zip(names, (float(y.mean()), *map(float, np.percentile(y, (50, 90, 95))), *fit)))
        return out

    got = per_group(spread, [*keys, "part"], "statistic string, value double", rows)
    by = got.groupBy(*keys, "statistic").agg(F.expr("percentile(value, array(0.025, 0.975))").alias("q"), F.count("value").alias("ok"), F.count(F.lit(1)).alias("n"))
    return by.where(F.col("ok") * 2 > F.col("n")).select(*keys, "statistic", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def weibull_bands(df: DataFrame, keys: list[str], block: int, points: int = 200, replicates: int | None = None, parts: int = 8, seed: int = 7) -> DataFrame:
    """(keys, x, density, low, high): a Weibull density at `points` values up to 1.2 times the greatest, with pointwise 95 % bands over block resamples.

    A resample that can't be fitted is left out; a series of which half or more can't gives no rows.
    """
    spread = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts))))

    def rows(x: np.ndarray, pdf: pd.DataFrame) -> list[tuple]:
        part = int(pdf["part"].iloc[0])
        if len(x) < 30:
            return []
        rng = np.random.default_rng([seed, part])
        out = []
        for _ in range(1 if part == parts else len(range(part, replicates or N.replicates_for(len(x)), parts))):
            try:
                shape, scale = N.weibull_moments(x if part == parts else N.block_resample(x, block, rng))
            except ValueError:
                shape = scale = None
            out.append((shape, scale, part == parts))
        return out

    fits = per_group(spread, [*keys, "part"], "shape double, scale double, whole boolean", rows)
    enough = fits.where("not whole").groupBy(*keys).agg(F.count("shape").alias("ok"), F.count(F.lit(1)).alias("n")).where("ok * 2 > n").select(*keys)
    top = df.groupBy(*keys).agg((F.max("value") * 1.2).alias("top"))
    grid = top.withColumn("x", F.explode(F.transform(F.sequence(F.lit(1), F.lit(points)), lambda k: k * F.col("top") / points)))
    at = fits.where("shape is not null").join(enough, keys).join(grid, keys)
    ratio = F.col("x") / F.col("scale")
    density = F.col("shape") / F.col("scale") * F.pow(ratio, F.col("shape") - 1) * F.exp(-F.pow(ratio, F.col("shape")))
    by = at.withColumn("f", density).groupBy(*keys, "x").agg(F.max(F.when(F.col("whole"), F.col("f"))).alias("density"), F.percentile(F.when(~F.col("whole"), F.col("f")), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return by.select(*keys, "x", "density", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def gpd_bootstrap(excess: DataFrame, replicates: int = 200, parts: int = 16, seed: int = 0) -> DataFrame:
    """(series_id, low, high, failed) of the GPD shape over ordinary resamples of `value`; resamples are spread over parts of each series."""
    types = dict(excess.dtypes)
    spread = excess.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["value"].dropna().to_numpy(dtype=float))
        rng = np.random.default_rng([seed, int(key[1])])
        out = []
        if len(x) >= 5:
            for _ in range(-(-replicates // parts)):
                try:
                    xi = N.gpd_fit(rng.choice(x, len(x)))[0]
                    out.append(xi if np.isfinite(xi) else None)
                except (ValueError, FloatingPointError):
                    out.append(None)
        return pd.DataFrame({"series_id": key[0], "xi": pd.Series(out, dtype=float)})

    got = spread.groupBy("series_id", "part").applyInPandas(run, f"series_id {types['series_id']}, xi double")
    stats = got.withColumn("xi", F.when(~F.isnan("xi"), F.col("xi"))).groupBy("series_id").agg(F.expr("percentile(xi, array(0.025, 0.975))").alias("q"), F.count("xi").alias("ok"), F.count(F.lit(1)).alias("n"))
    return stats.where(F.col("ok") * 2 > F.col("n")).select("series_id", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), (F.col("n") - F.col("ok")).alias("failed"))


def share_bootstrap(labels: DataFrame, block: int, replicates: int = 200, seed: int = 0) -> DataFrame:
    """(series_id, label, share, low, high) of labels (series_id, seg_id, us, label): block resamples inside each segment of max(5, block / 4) rows or more."""
    types = dict(labels.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("us")
        rng = np.random.default_rng(seed)
        parts = [g["label"].to_numpy() for _, g in pdf.groupby("seg_id") if len(g) >= max(5, block // 4)]
        kinds = sorted(pdf["label"].dropna().unique())
        draws = [np.concatenate([N.block_resample(p, block, rng) for p in parts]) for _ in range(replicates)] if parts else []
        out = []
        for k in kinds:
            v = [float((d == k).mean()) for d in draws]
            out.append((key[0], int(k), float((pdf["label"] == k).mean()), *(map(float, np.percentile(v, (2.5, 97.5))) if v else (None, None))))
        return pd.DataFrame(out, columns=["series_id", "label", "share", "low", "high"])

    return labels.groupBy("series_id").applyInPandas(run, f"series_id {types['series_id']}, label int, share double, low double, high double")


def jackknife_max(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shape, shape_without_max, shape_change_pct, scale_change_pct) of Weibull moment fits with and without the largest value."""

    def rows(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        if len(x[x > 0]) < 10:
            return []
        k, c = N.weibull_moments(x)
        k2, c2 = N.weibull_moments(np.delete(x, int(np.argmax(x))))
        return [(k, k2, 100 * (k2 - k) / k, 100 * (c2 - c) / c)]

    return per_group(df, keys, "shape double, shape_without_max double, shape_change_pct double, scale_change_pct double", rows)


def hidden_regimes(segments: DataFrame, states: int = 4, dt_hours: float = 1.0) -> DataFrame:
    """(series_id, state, mean, share, stay, dwell_hours, moves): a Gaussian hidden Markov model over a series' segments (series_id, seg_id, ts, value)."""
    types = dict(segments.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["value"]).sort_values(["seg_id", "ts"])
        x = pdf["value"].to_numpy(dtype=float)
        out = []
        if len(x) >= 10 * states:
            mean, _, move, path = N.gaussian_hmm(x, pdf.groupby("seg_id", sort=True).size().tolist(), states)
            for k in range(states):
                stay = float(move[k, k])
                out.append((key[0], k, float(mean[k]), float((path == k).mean()), stay, dt_hours / max(1 - stay, 1e-12), [float(v) for v in move[k]]))
        return pd.DataFrame(out, columns=["series_id", "state", "mean", "share", "stay", "dwell_hours", "moves"])

    return segments.groupBy("series_id").applyInPandas(run, f"series_id {types['series_id']}, state int, mean double, share double, stay double, dwell_hours double, moves array<double>")


def order_search(segments: DataFrame, most: int = 3, rows_used: int = 4000, d_range: tuple[int, ...] = (0,)) -> DataFrame:
    """(series_id, p, d, q, aic, best): every ARMA order is its own task for each series."""
    orders = [(p, d, q) for p in range(most + 1) for d in d_range for q in range(most + 1) if p + q]
    grid = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(q).alias("q")) for p, d, q in orders)))
    spread = segments.where(F.col("idx") < rows_used).withColumn("o", grid).select("series_id", "ts", "value", "o.p", "o.d", "o.q")

    def rows(x: np.ndarray, pdf: pd.DataFrame) -> list[tuple]:
        p, d, q = (int(pdf[c].iloc[0]) for c in "pdq")
        y = np.diff(x, d) if d else x
        if len(y) < 10 * (p + q + 1) or y.std() == 0:
            return []
        return [(N.arma_css(y, p, q)["aic"],)]

    out = per_group(spread, ["series_id", "p", "d", "q"], "aic double", rows)
    first = F.row_number().over(Window.partitionBy("series_id").orderBy("aic", "p", "d", "q"))
    return out.withColumn("best", first == 1)


def arma_backtest(segments: DataFrame, p: int, q: int, horizons: list[int], fit_rows: int, origin_step: int, window: int, exog: str | None = None, exog_lag: int = 0, garch: bool = False) -> DataFrame:
    """(series_id, model, origin_idx, horizon, actual, predicted, error, half_width): fit on the first rows, then forecasts from origins after them.

    segments: series_id, idx, value of one gap-free stretch a series, and a
    driver column for exog. A driver known at `lag` rows back is used while it
    lies at or before the origin, later its last value. half_width: of the
    95 % interval, from psi weights and a constant or GARCH variance.
    """
    types = dict(segments.dtypes)
    name = ("armax" if exog else "arma") + ("_garch" if garch else "")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["series_id", "model", "origin_idx", "horizon", "actual", "predicted", "error", "half_width"]
        pdf = pdf.sort_values("idx")
        y = pdf["value"].to_numpy(dtype=float)
        n, top = len(y), max(horizons)
        drive = pdf[exog].shift(exog_lag).to_numpy(dtype=float) if exog else None
        usable = ~np.isnan(y[:fit_rows]) if drive is None else ~(np.isnan(y[:fit_rows]) | np.isnan(drive[:fit_rows]))
        if usable.sum() < 20 * (p + q + 1) or np.nanstd(y[:fit_rows]) == 0:
            return pd.DataFrame(columns=columns)
        m = N.arma_css(y[:fit_rows][usable], p, q, None if drive is None else drive[:fit_rows][usable])
        level = np.full(n, m["beta"][0]) if drive is None else m["beta"][0] + m["beta"][1] * drive
        psi2 = N.psi_weights(m["ar"], m["ma"], top)
        parameters = N.garch_fit(m["residuals"]) if garch else None
        out = []
        raw = pdf[exog].to_numpy(dtype=float) if exog else None
        for origin in range(fit_rows, n, origin_step):
            lo = max(0, origin + 1 - window)
            z = (y - level)[lo : origin + 1]
            z = z[~np.isnan(z)]
            if len(z) < 5:
                continue
            ahead = N.arma_forecast(z, m["ar"], m["ma"], top)
            if garch:
                e = N.arma_residuals(z, m["ar"], m["ma"])
                h = N.garch_variance(e, *parameters, float(np.var(z)))[-1]
                steps = N.garch_forecast(parameters[0] + parameters[1] * e[-1] ** 2 + parameters[2] * h, *parameters, top)
            else:
                steps = np.full(top, m["sigma2"])
            spread = N.error_variance(psi2, steps)
            for k in horizons:
                if origin + k >= n or np.isnan(y[origin + k]):
                    continue
                if drive is None:
                    base = m["beta"][0]
                else:
                    known = raw[min(origin + k - exog_lag, origin)] if origin + k - exog_lag >= 0 else np.nan
                    base = m["beta"][0] + m["beta"][1] * known
                guess = float(base + ahead[k - 1])
                if np.isfinite(guess):
                    out.append((key[0], name, origin, k, float(y[origin + k]), guess, float(y[origin + k] - guess), 1.959963984540054 * float(np.sqrt(spread[k - 1]))))
        return pd.DataFrame(out, columns=columns)

    return segments.groupBy("series_id").applyInPandas(run, f"series_id {types['series_id']}, model string, origin_idx long, horizon int, actual double, predicted double, error double, half_width double")
