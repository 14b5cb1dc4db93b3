"""Queries that chain several operators: trend verdicts, stability over windows, settings of extremes, driver coupling, deltas."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import estimators as E
from ..operators import forecast as FC
from ..operators import learning as ML
from ..operators import stats, windows
from ..operators.ordered import Ordered
from ..sources import tables
from ..sources.tables import table
from .estimator_sql import ESTIMATOR_SQL
from .series_queries import _R4, Query, _indexed, events, mean_of_cents, off_ties
from .stat_queries import _CCF, _TREND, _peaks, _trend_points, _wide, monthly_orders, record_years

# Readings of a GPD shape and of the candidate distributions.
SHAPE_TEXT = (("heavy tail, no upper bound", 0.1), ("near exponential", -0.1))
DISTRIBUTION_TEXT = {"rayleigh": "narrow-banded sea state", "weibull": "long-term mix of sea states", "lognormal": "multiplicative growth, heavy right tail"}


def sample_coverage(spark, d):
    out = tables.coverage(events(spark, d))
    return out.select("series_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n", "n_valid")


def trend_verdicts(spark, d):
    """Mann-Kendall with the Hamed-Rao factor, and a verdict; under 8 points it is too short."""
    p = _trend_points(spark, d)
    k = stats.kendall_s(p).join(stats.hamed_rao(p), "series_id")
    z = F.col("z") / F.sqrt("correction")
    pv = S.normal_two_sided(z)
    verdict = F.when(F.col("n") < 8, "too_short").when(pv >= 0.05, "no_trend").when(F.col("s") > 0, "increasing").otherwise("decreasing")
    return k.select("series_id", "n", off_ties(z, 5).alias("z"), verdict.alias("verdict"))


def sparse_years(spark, d):
    """Years with under half of the days that they could have."""
    days = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("ts")).agg(F.max("o_totalprice").alias("value"))
    out = stats.yearly_coverage(days, S.STORM_MONTHS)
    return out.where("pct < 50").select("series_id", F.col("year").cast("long").alias("year"), "valid")


def change_coverage(spark, d):
    """Segments between change points of the monthly means, and the years of thin storm seasons inside each."""
    m = monthly_orders(spark, d).select("series_id", F.col("month").alias("ts"), "value")
    breaks = E.change_points(m, ["series_id"], multipliers=(1.0,), jump=1).select("series_id", F.col("break_idx").cast("long").alias("idx"))
    rows = Ordered(m.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), ["series_id"]).index("idx").done()
    cut = rows.join(breaks.withColumn("b", F.lit(1)), ["series_id", "idx"], "left")
    segs = Ordered(cut, ["series_id"]).running_sum(F.coalesce("b", F.lit(0)), "seg").done().groupBy("series_id", "seg").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.avg("value").alias("mean"))
    days = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("ts")).agg(F.max("o_totalprice").alias("value"))
    thin = stats.yearly_coverage(days, S.STORM_MONTHS).where("storm_pct < 80 and not boundary").select(F.col("series_id").alias("s"), "year")
    met = segs.join(thin, (F.col("series_id") == F.col("s")) & F.col("year").between(F.year("start"), F.year("end")), "left")
    month = lambda c: F.date_format(c, "yyyy-MM").alias(c)
    out = met.groupBy("series_id", "seg", "start", "end", "mean").agg(F.concat_ws(",", F.sort_array(F.collect_list("year")).cast("array<string>")).alias("thin_years"))
    return out.select("series_id", F.col("seg").cast("long").alias("seg"), month("start"), month("end"), off_ties("mean", 2).alias("mean"), "thin_years")


def window_stability(spark, d):
    """Best distribution in each of four calendar windows, the share of windows that agree, and the range of their means."""
    w = windows.calendar_windows(events(spark, d), 4)
    enough = w.groupBy("series_id", "window").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).where("n >= 30")
    best = E.fits(w.select("series_id", "window", "ts", "value"), ["series_id", "window"]).where("best").select("series_id", "window", "name")
    got = enough.join(best, ["series_id", "window"])
    shares = got.groupBy("series_id", "name").agg(F.count(F.lit(1)).alias("c"))
    top = shares.groupBy("series_id").agg(F.max(F.struct("c", "name")).alias("t"), F.sum("c").alias("n"))
    span = got.groupBy("series_id").agg((F.max("mean") - F.min("mean")).alias("mean_range"))
    return top.join(span, "series_id").select("series_id", F.col("t.name").alias("best"), (F.col("t.c") / F.col("n")).alias("agreement"), "mean_range")


def distribution_readings(spark, d):
    best = E.fits(events(spark, d), ["series_id"]).where("best")
    text = F.coalesce(*(F.when(F.col("name") == n, F.lit(t)) for n, t in DISTRIBUTION_TEXT.items()))
    return best.select("series_id", "name", "ks", text.alias("reading"))


def extreme_readings(spark, d):
    g = E.gpd(*_peaks(spark, d))
    (heavy, a), (near, b) = SHAPE_TEXT
    text = F.when(F.col("xi") > a, heavy).when(F.col("xi") >= b, near).otherwise("bounded tail")
    return g.select("series_id", "n_peaks", off_ties("xi", 3).alias("xi"), F.when(F.col("few"), F.concat(text, F.lit(", from few peaks"))).otherwise(text).alias("reading"))


def extreme_settings(spark, d):
    """Peaks, shapes and 50-year levels over a table of thresholds and separations; candidates are found once for all."""
    e = events(spark, d)
    quantiles = (0.85, 0.9, 0.95)
    u = e.groupBy("series_id").agg(F.percentile("value", F.array(*map(F.lit, quantiles))).alias("u"))
    asks = u.select("series_id", F.explode(F.arrays_zip("u", F.array(*map(F.lit, quantiles)).alias("q"))).alias("a"))
    asks = asks.select("series_id", F.col("a.u").alias("threshold"), F.col("a.q").alias("quantile"), F.explode(F.array(F.lit(2), F.lit(8))).alias("distance"))
    fits = E.gpd(E.declustered_peaks(e, asks), asks).join(asks, ["series_id", "quantile", "distance"]).join(record_years(spark, d), "series_id")
    level = S.gpd_return_level(F.col("threshold"), F.col("sigma"), F.col("xi"), F.col("n_peaks") / F.col("years"), F.lit(50.0))
    return fits.select("series_id", "quantile", F.col("distance").cast("long").alias("distance"), "n_peaks", off_ties("xi", 3).alias("xi"), off_ties(level, 0).alias("level_50"))


def driver_coupling(spark, d):
    """How clicks follow views: strongest lag, and explained variance of a line and of a square."""
    w = _wide(spark, d)
    lag = stats.best_lag(stats.cross_correlation(w, "view", "click", 12), ["series_id"])
    fit = w.groupBy("series_id").agg(F.regr_r2("click", "view").alias("r2"), F.regr_r2(F.col("click"), F.col("view") * F.col("view")).alias("r2_square"))
    return lag.join(fit, "series_id").select(F.col("lag").cast("long").alias("lag"), off_ties("r", 8).alias("r"), off_ties("r2", 8).alias("r2"), off_ties("r2_square", 8).alias("r2_square"))


def deseasonalised_timescales(spark, d):
    """Timescales of the hourly grids before and after daily harmonics are taken out."""
    from .series_queries import hourly

    g = hourly(spark, d).select("series_id", "ts", "value")
    raw = E.timescales(g, ["series_id"], 1.0).select("series_id", F.col("tau_hours").alias("raw_tau"))
    clean = stats.harmonic_regression(g, [(24.0, 3)]).select("series_id", "ts", F.col("residual").alias("value"))
    both = raw.join(E.timescales(clean, ["series_id"], 1.0).select("series_id", "tau_hours"), "series_id")
    return both.select("series_id", off_ties("raw_tau", 5).alias("raw_tau"), off_ties("tau_hours", 5).alias("tau_hours"))


def exceedance_deltas(spark, d):
    """Brier skill of exceedance forecasts with and without another series' level as a feature."""
    rows = _indexed(spark, d)
    u = rows.groupBy("series_id").agg(F.percentile("value", 0.9).alias("threshold"))
    drive = rows.where("series_id = 'view'").select("us", F.col("value").alias("drive"))
    f = windows.exceedance_label(windows.exceedance_features(rows.join(u, "series_id")), 6).where("value is not null and label is not null").join(drive, "us").where("drive is not null")
    own = FC.brier(ML.exceedance_model(f, ["level", "trend", "volatility"]), ["series_id"]).select("series_id", F.col("skill").alias("skill"))
    with_ = FC.brier(ML.exceedance_model(f, ["level", "trend", "volatility", "drive"]), ["series_id"]).select("series_id", F.col("skill").alias("skill_driven"))
    return own.join(with_, "series_id").withColumn("delta", F.col("skill_driven") - F.col("skill"))


def weibull_band(spark, d):
    """Pointwise 95 % bands of a Weibull density over block resamples."""
    return E.weibull_bands(events(spark, d), ["series_id"], 24)


def fingerprint_features(spark, d):
    """One row a series: mean, deviation, share of each regime, stretches, trend; missing ones filled by the mean, with the share missing."""
    e = events(spark, d)
    base = e.groupBy("series_id").agg(mean_of_cents("value").alias("mean"), F.max("value").alias("max"))
    part = e.withColumn("regime", F.when(F.col("value") > 60, "high").otherwise("low")).groupBy("series_id").pivot("regime", ["low", "high"]).count()
    tail = e.where("value > 345").groupBy("series_id").agg(F.count(F.lit(1)).cast("double").alias("tail"))
    got = base.join(part, "series_id", "left").join(tail, "series_id", "left").withColumn("high_share", F.col("high") / (F.col("high") + F.col("low")))
    all_ = Window.partitionBy()
    return got.select("series_id", "mean", "max", "high_share", F.coalesce("tail", F.avg("tail").over(all_)).alias("tail"), F.avg(F.col("tail").isNull().cast("double")).over(all_).alias("tail_missing"))


def persistence_hours(spark, d):
    """Horizons in hours, given as text, turned to samples of each era's step."""
    asks = spark.range(1).select(F.explode(S.floats(F.lit("1, 3, 0.2, 12"))).alias("hours")).crossJoin(spark.range(1).select(F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0))).alias("dt")))
    return asks.select("hours", "dt", F.greatest(F.lit(1), F.rint(F.col("hours") / F.col("dt"))).cast("long").alias("samples"))


_KT = f"{_TREND}, p AS (SELECT a.series_id, sign(b.v - a.v) AS sg FROM tp a JOIN tp b ON a.series_id = b.series_id AND a.t < b.t), s AS (SELECT series_id, sum(sg)::BIGINT AS s FROM p GROUP BY 1), n AS (SELECT series_id, count(*) AS n FROM tp GROUP BY 1), rr AS (SELECT series_id, t, rank() OVER (PARTITION BY series_id ORDER BY v) + (count(*) OVER (PARTITION BY series_id, v) - 1) / 2.0 AS rk, row_number() OVER (PARTITION BY series_id ORDER BY t) AS j, count(*) OVER (PARTITION BY series_id) AS n FROM tp), z AS (SELECT *, rk - (n + 1) / 2.0 AS z FROM rr), dd AS (SELECT series_id, sum(z * z) AS d FROM z GROUP BY 1), c AS (SELECT x.series_id, x.n, y.j - x.j AS lag, sum(x.z * y.z) / any_value(d) AS rho FROM z x JOIN z y ON x.series_id = y.series_id AND y.j > x.j JOIN dd ON dd.series_id = x.series_id GROUP BY ALL), f AS (SELECT series_id, greatest(1, 1 + 2.0 / (any_value(n) * (any_value(n) - 1) * (any_value(n) - 2)) * coalesce(sum(CASE WHEN lag <= n - 2 AND rho > (-1 + 1.96 * sqrt(n - 2)) / (n - 1) THEN (n - lag) * (n - lag - 1) * (n - lag - 2) * rho END), 0)) AS cf FROM c GROUP BY series_id), v AS (SELECT s.series_id, n.n, s, (s - sign(s)) / sqrt(n.n * (n.n - 1) * (2 * n.n + 5) / 18.0) / sqrt(cf) AS zz FROM s JOIN n USING (series_id) JOIN f USING (series_id))"

COMBINED: dict[str, tuple[Query, str | None]] = {
    "sample_coverage": (sample_coverage, "SELECT event_type AS series_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n, count(value) AS n_valid FROM events GROUP BY 1"),
    "trend_verdicts": (trend_verdicts, f"WITH {_KT} SELECT series_id, n, {_R4('zz', 5)} AS z, CASE WHEN n < 8 THEN 'too_short' WHEN abs(zz) <= 1.959963984540054 THEN 'no_trend' WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS verdict FROM v"),
    "sparse_years": (sparse_years, "WITH d AS (SELECT DISTINCT o_orderpriority AS series_id, o_orderdate::DATE AS dd FROM orders), y AS (SELECT series_id, year(dd) AS year, count(*) AS valid FROM d GROUP BY ALL) SELECT series_id, year, valid FROM y WHERE floor(1000.0 * valid / (make_date(year + 1, 1, 1) - make_date(year, 1, 1)) + 0.5) / 10 < 50"),
    "driver_coupling": (driver_coupling, f"WITH {_CCF}, b AS (SELECT lag, r FROM cc WHERE n > 10 ORDER BY abs(r) DESC, lag LIMIT 1), q AS (SELECT regr_r2(click, view) AS r2, regr_r2(click, view * view) AS r2s FROM wi) SELECT lag, {_R4('r', 8)} AS r, {_R4('r2', 8)} AS r2, {_R4('r2s', 8)} AS r2_square FROM b, q"),
    "fingerprint_features": (fingerprint_features, "WITH e AS (SELECT event_type AS series_id, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / (100 * count(*)) AS mean, max(value) AS max, count(*) FILTER (WHERE value > 60)::DOUBLE / count(*) AS high_share, nullif(count(*) FILTER (WHERE value > 345), 0)::DOUBLE AS tail FROM events GROUP BY 1) SELECT series_id, mean, max, high_share, coalesce(tail, avg(tail) OVER ()) AS tail, avg((tail IS NULL)::INT) OVER () AS tail_missing FROM e"),
    "persistence_hours": (persistence_hours, "SELECT hours, dt, greatest(1, round_even(hours / dt, 0))::BIGINT AS samples FROM (VALUES (1.0::DOUBLE), (3.0::DOUBLE), (0.2::DOUBLE), (12.0::DOUBLE)) a(hours), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) b(dt)"),
    **{f.__name__: (f, ESTIMATOR_SQL[f.__name__]) for f in (change_coverage, extreme_readings, extreme_settings, deseasonalised_timescales)},
    **{f.__name__: (f, None) for f in (window_stability, distribution_readings, exceedance_deltas, weibull_band)},
}
