"""Queries over the shared tables: aggregates, dependence, extremes, forecasts, networks, estimators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import estimators as E
from ..operators import forecast as FC
from ..operators import learning as ML
from ..operators import segments, stats, windows
from ..operators.ordered import Ordered, with_micros
from ..sources.tables import table
from .estimator_sql import ESTIMATOR_SQL, MONTHS
from .series_queries import _GRID, _R4, HOUR_US, WEEK_US, Query, _indexed, events, hourly, mean_of_cents, off_ties


def tumbling_three_hours(spark, d):
    e = events(spark, d)
    by = e.groupBy("series_id", F.window("ts", "3 hours").alias("w")).agg(mean_of_cents("value").alias("mean"), F.max("value").alias("max"))
    return by.select("series_id", F.unix_micros("w.start").alias("start_us"), "mean", "max")


def annual_statistics(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), mean_of_cents("o_totalprice").alias("mean"), off_ties(F.percentile("o_totalprice", 0.95)).alias("p95"), F.median("o_totalprice").alias("median"))


def monthly_orders(spark, d):
    """series_id, month, value of the mean order of each priority; months without orders are interpolated."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("value"))
    return stats.monthly_profile(o, mean_of_cents("value"))


def monthly_profile(spark, d):
    return monthly_orders(spark, d).select("series_id", F.date_format("month", "yyyy-MM").alias("month"), off_ties("value", 2).alias("value"), "was_missing")


def seasonal_extremes(spark, d):
    by = monthly_orders(spark, d).groupBy("series_id", F.month("month").cast("long").alias("m")).agg(off_ties(F.avg("value"), 2).alias("v"))
    return by.groupBy("series_id").agg(F.max_by("m", F.struct("v", (-F.col("m")).alias("k"))).alias("peak"), F.min_by("m", F.struct("v", "m")).alias("trough"))


def yearly_coverage(spark, d):
    days = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("ts")).agg(F.max("o_totalprice").alias("value"))
    out = stats.yearly_coverage(days, S.STORM_MONTHS)
    return out.select("series_id", F.col("year").cast("long").alias("year"), "valid", off_ties("pct", 1).alias("pct"), "storm_valid", off_ties("storm_pct", 1).alias("storm_pct"), "boundary")


def value_shares(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("event_type", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def moments(spark, d):
    li = table(spark, d, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return li.groupBy("l_returnflag").agg(
        off_ties(F.var_samp(q), 6).alias("var_samp"), off_ties(F.var_pop(q), 6).alias("var_pop"), off_ties(F.covar_samp(q, p), 2).alias("cov"), off_ties(F.corr(q, p), 8).alias("r"), off_ties(F.regr_slope(p, q), 4).alias("slope"), off_ties(F.regr_r2(p, q), 8).alias("r2"), off_ties(F.regr_r2(p, q * q), 8).alias("r2_square"), F.count_distinct("l_partkey").alias("parts")
    )


def imputed(spark, d):
    """The mean order of each customer; those without orders get the mean of the others."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(mean_of_cents("o_totalprice").alias("x"))
    c = table(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "x")
    m = c.agg(mean_of_cents("x").alias("m"), (F.sum(F.col("x").isNull().cast("long")) / F.count(F.lit(1))).alias("missing"))
    return c.crossJoin(F.broadcast(m)).select("c_custkey", F.coalesce("x", "m").alias("x"), "missing")


def pairwise_correlation(spark, d):
    return stats.pairwise_correlation(hourly(spark, d)).select("a", "b", "n", off_ties("r", 8).alias("r"))


def rank_correlation(spark, d):
    return stats.pairwise_correlation(hourly(spark, d), method="spearman").select("a", "b", "n", off_ties("r", 8).alias("r"))


def _nation_days(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").cast("long").alias("series_id"), F.trunc("o_orderdate", "month").alias("ts")).agg(mean_of_cents("o_totalprice").alias("value"))


def correlation_by_distance(spark, d):
    r = stats.pairwise_correlation(_nation_days(spark, d))
    lat, lon = (lambda c: F.col(c) * 3.0 - 30.0), (lambda c: F.col(c) * 7.0 - 80.0)
    p = r.withColumn("km", S.haversine_km(lat("a"), lon("a"), lat("b"), lon("b"))).where("r is not null")
    ranked = stats.average_ranks(stats.average_ranks(p.withColumn("k", F.lit(1)), ["k"], "km", "rk"), ["k"], "r", "rr")
    return ranked.agg(F.count(F.lit(1)).alias("pairs"), off_ties(F.corr("rk", "rr"), 6).alias("spearman"), off_ties(F.regr_slope("r", "km") * 1000, 6).alias("slope"), off_ties(F.regr_intercept("r", "km"), 6).alias("intercept"))


def correlation_intervals(spark, d):
    h = hourly(spark, d)
    r = stats.pairwise_correlation(h)
    a1 = stats.autocorrelation(_indexed(spark, d).where("value is not null"), 1).select("series_id", F.col("rho").alias("r1"))
    p = r.join(a1.withColumnRenamed("series_id", "a"), "a").join(a1.select(F.col("series_id").alias("b"), F.col("r1").alias("r2")), "b")
    out = stats.correlation_interval(p)
    return out.select("a", "b", off_ties("n_effective", 4).alias("n_effective"), off_ties("ci_low", 6).alias("ci_low"), off_ties("ci_high", 6).alias("ci_high"))


def _wide(spark, d):
    g = hourly(spark, d).where("series_id in ('view', 'click')")
    w = g.groupBy("us").pivot("series_id", ["view", "click"]).agg(F.first("value"))
    return Ordered(w.withColumn("series_id", F.lit("all")), ["series_id"], chunk_us=WEEK_US).index("idx").done()


def lagged_correlation(spark, d):
    return stats.cross_correlation(_wide(spark, d), "view", "click", 12).select(F.col("lag").cast("long").alias("lag"), "n", off_ties("r", 8).alias("r"))


def strongest_lag(spark, d):
    ccf = stats.cross_correlation(_wide(spark, d), "view", "click", 12)
    return stats.best_lag(ccf, ["series_id"]).select(F.col("lag").cast("long").alias("lag"), off_ties("r", 8).alias("r"))


def _packed(spark, d):
    return Ordered(hourly(spark, d).where("value is not null"), ["series_id"]).index("idx").done()


def autocorrelation(spark, d):
    return stats.autocorrelation(_packed(spark, d), 24).select("series_id", F.col("lag").cast("long").alias("lag"), off_ties("rho", 8).alias("rho"))


def ljung_box(spark, d):
    q = stats.ljung_box(stats.autocorrelation(_packed(spark, d), 24), [6, 12, 24])
    return q.select("series_id", F.col("lags").cast("long").alias("lags"), off_ties("q", 4).alias("q"))


def _trend_points(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("t")).agg(mean_of_cents("o_totalprice").alias("value"))


def kendall_trend(spark, d):
    out = stats.kendall_s(_trend_points(spark, d))
    return out.select("series_id", "n", "s", off_ties("z", 6).alias("z"), off_ties("sen_slope", 4).alias("sen_slope"))


def trend_correction(spark, d):
    return stats.hamed_rao(_trend_points(spark, d)).select("series_id", off_ties("correction", 6).alias("correction"))


def residual_life(spark, d):
    out = stats.mean_residual_life(events(spark, d).select("series_id", "value"))
    return out.select("series_id", F.col("k").cast("long").alias("k"), off_ties("threshold", 6).alias("threshold"), "n", off_ties("mean_excess", 6).alias("mean_excess"), off_ties("se", 6).alias("se"))


def uniform_distance(spark, d):
    top = events(spark, d).groupBy("series_id").agg(F.max("value").alias("top"))
    out = stats.ks_distance(events(spark, d).join(top, "series_id"), F.col("value") / F.col("top"))
    return out.select("series_id", "n", off_ties("ks", 8).alias("ks"))


def over_threshold(spark, d):
    u = events(spark, d).groupBy("series_id").agg(F.percentile("value", 0.95).alias("u"))
    met = events(spark, d).join(u, "series_id").where("value > u")
    return met.groupBy("series_id", "u").agg(F.count(F.lit(1)).alias("n"), off_ties(F.avg(F.col("value") - F.col("u")), 6).alias("mean_excess"))


def record_years(spark, d):
    """series_id, years: time from the first to the last sample."""
    us = F.unix_micros("ts")
    return events(spark, d).groupBy("series_id").agg(((F.max(us) - F.min(us)) / F.lit(S.YEAR_US)).alias("years"))


def return_levels(spark, d):
    rates = over_threshold(spark, d).join(record_years(spark, d), "series_id").select("series_id", "u", (F.col("n") / F.col("years")).alias("per_year"), F.col("mean_excess").alias("sigma"))
    asks = rates.withColumn("years", F.explode(F.array(F.lit(1.0), F.lit(10.0), F.lit(50.0)))).withColumn("xi", F.explode(F.array(F.lit(0.0), F.lit(-0.1), F.lit(0.2))))
    level = S.gpd_return_level(F.col("u"), F.col("sigma"), F.col("xi"), F.col("per_year"), F.col("years"))
    return asks.select("series_id", "years", "xi", off_ties(level, 4).alias("level"))


def without_largest(spark, d):
    r = events(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("value"), "ts"))).where("r > 1")
    return r.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), mean_of_cents("value").alias("mean"), F.max("value").alias("max"))


def histogram(spark, d):
    ends = events(spark, d).groupBy("series_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 40), F.lit(39)).cast("long")
    return events(spark, d).join(ends, "series_id").groupBy("series_id", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def fourier_power(spark, d):
    out = stats.fourier_power(hourly(spark, d), [6.0, 12.0, 12.4206, 24.0])
    return out.select("series_id", "period_hours", off_ties("power", 4).alias("power"))


def harmonic_residuals(spark, d):
    out = stats.harmonic_regression(hourly(spark, d).select("series_id", "ts", "value"), [(24.0, 2)])
    return out.groupBy("series_id").agg(F.count("residual").alias("n"), off_ties(F.avg(F.col("residual") * F.col("residual")), 4).alias("mse"), F.count("fitted").alias("fitted"))


def persistence_backtest(spark, d):
    out = FC.persistence(_indexed(spark, d), [1, 3, 6], 5, 24, 3)
    return out.select("series_id", "origin_idx", F.col("horizon_samples").cast("long").alias("horizon"), "actual", "predicted", "error")


def persistence_summary(spark, d):
    out = FC.summarize(FC.persistence(_indexed(spark, d), [1, 3, 6], 5, 24, 3), 1.0)
    return out.select("series_id", F.col("horizon_samples").cast("long").alias("horizon"), "n", off_ties("rmse", 6).alias("rmse"), off_ties("mae", 6).alias("mae"))


def _mean_forecast(spark, d):
    rows = windows.trailing_rows(_indexed(spark, d), 24, {"m": F.avg("value")})
    p = FC.persistence(_indexed(spark, d), [1, 3, 6], 5, 24, 3)
    m = rows.select("series_id", F.col("idx").alias("origin_idx"), "m")
    return p.join(m, ["series_id", "origin_idx"]).withColumn("error", F.col("actual") - F.col("m"))


def forecast_skill(spark, d):
    base = FC.summarize(FC.persistence(_indexed(spark, d), [1, 3, 6], 5, 24, 3), 1.0)
    out = FC.skill(FC.summarize(_mean_forecast(spark, d), 1.0), base)
    return out.select("series_id", F.col("horizon_samples").cast("long").alias("horizon"), off_ties("skill", 6).alias("skill"))


def _scored(spark, d):
    e = events(spark, d)
    u = e.groupBy("series_id").agg(F.percentile("value", 0.9).alias("u"), F.max("value").alias("top"))
    rows = Ordered(with_micros(e.select("series_id", "ts", "value")), ["series_id"]).previous("value", "before").done().join(u, "series_id").where("before is not null")
    return rows.select("series_id", (F.col("value") > F.col("u")).cast("int").alias("label"), (F.round(F.col("before") / F.col("top") * 1000) / 1000).alias("p"))


def brier_scores(spark, d):
    out = FC.brier(_scored(spark, d), ["series_id"])
    return out.select("series_id", "n", off_ties("brier", 8).alias("brier"), off_ties("baseline", 8).alias("baseline"), off_ties("skill", 6).alias("skill"))


def ranking_quality(spark, d):
    return FC.roc_auc(_scored(spark, d), ["series_id"]).select("series_id", off_ties("auc", 8).alias("auc"))


# --- estimators without SQL --------------------------------------------------


def _segments(spark, d):
    """The hourly grids' short gaps filled, so that series have long stretches; series_id, seg_id, ts, us, idx, value."""
    from ..operators import regularize

    grid = hourly(spark, d).select("series_id", F.col("us").alias("slot_us"), "value")
    full = regularize.interpolate_short(regularize.classify_gaps(grid)).select("series_id", F.timestamp_micros("slot_us").alias("ts"), F.col("slot_us").alias("us"), "value")
    lab = segments.label_runs(full.drop("us")).withColumn("us", F.unix_micros("ts"))
    long = lab.groupBy("series_id", "seg_id").agg(F.count(F.lit(1)).alias("len"))
    return Ordered(lab.join(long, ["series_id", "seg_id"]).where("len >= 48"), ["series_id", "seg_id"]).index("idx").done()


def _longest(spark, d):
    s = _segments(spark, d)
    best = s.groupBy("series_id").agg(F.max(F.struct("len", (-F.col("seg_id")).alias("m"))).alias("b")).select("series_id", (-F.col("b.m")).alias("seg_id"))
    return s.join(best, ["series_id", "seg_id"])


def _spectra(spark, d):
    return E.spectra(_longest(spark, d), ["series_id"], 1.0)


def spectra(spark, d):
    return _spectra(spark, d).select("series_id", off_ties("frequency", 8).alias("frequency"), off_ties("period_hours", 6).alias("period_hours"), off_ties("power").alias("power"))


def spectral_ratios(spark, d):
    out = E.peak_over_baseline(_spectra(spark, d), ["series_id"], 24.0, 1.0, (6.0, 48.0), [(24.0, 1.0)])
    return out.select("series_id", off_ties("ratio", 6).alias("ratio"))


def dominant_period(spark, d):
    out = E.dominant_periods(_spectra(spark, d), ["series_id"], 4.0, 30.0)
    return out.select("series_id", off_ties("period_hours", 6).alias("period_hours"), "constituent")


def power_transform(spark, d):
    """The power of highest likelihood, and the mean and deviation of what it gives."""
    out = E.box_cox(events(spark, d).select("series_id", "ts", "value"), ["series_id"])
    by = out.groupBy("series_id").agg(F.count("transformed").alias("n"), F.max("lambda").alias("lambda"), F.avg("transformed").alias("mean"), F.stddev_pop("transformed").alias("deviation"))
    return by.select("series_id", "n", off_ties("lambda", 3).alias("lambda"), off_ties("mean", 2).alias("mean"), off_ties("deviation", 2).alias("deviation"))


def singular_spectrum(spark, d):
    return E.ssa(_longest(spark, d), ["series_id"], 1.0, 24, 6)


def seasonal_decomposition(spark, d):
    m = monthly_orders(spark, d).select("series_id", F.col("month").cast("timestamp").alias("ts"), "value")
    return E.stl(m, ["series_id"])


def seasonal_shares(spark, d):
    return E.variance_shares(seasonal_decomposition(spark, d), ["series_id"])


def partial_autocorrelation(spark, d):
    out = E.autocorrelations(_longest(spark, d), ["series_id"], 24)
    return out.select("series_id", F.col("lag").cast("long").alias("lag"), off_ties("acf", 6).alias("acf"), off_ties("pacf", 6).alias("pacf"))


def _timescales(spark, d):
    s = _segments(spark, d)
    start = s.groupBy("series_id", "seg_id").agg(F.min("us").alias("start_us"))
    return E.timescales(s, ["series_id", "seg_id"], 1.0).join(start, ["series_id", "seg_id"])


def timescales(spark, d):
    return _timescales(spark, d).select("series_id", "start_us", "n", off_ties("tau_hours", 5).alias("tau_hours"), off_ties("lag1", 6).alias("lag1"), F.col("cut_lag").cast("long").alias("cut_lag"), "hit_ceiling")


def dependence(spark, d):
    out = E.dependence_summary(_timescales(spark, d), 1.0)
    return out.select("series_id", off_ties("tau_hours", 5).alias("tau_hours"), off_ties("lag1", 6).alias("lag1"), "hit_ceiling", "block_length", off_ties(2 * F.col("tau_hours"), 1).alias("decluster_hours"))


def stationarity(spark, d):
    out = E.stationarity(_longest(spark, d), ["series_id"])
    return out.select("series_id", "n", off_ties("adf").alias("adf"), off_ties("kpss").alias("kpss"), off_ties("kpss_p").alias("kpss_p"), "verdict")


def _residuals(spark, d):
    """What two daily harmonics leave of the hourly grids."""
    out = stats.harmonic_regression(hourly(spark, d).select("series_id", "ts", "value"), [(24.0, 2)])
    return out.where("residual is not null").select("series_id", "ts", F.col("residual").alias("value"))


def whiteness(spark, d):
    out = E.whiteness(_residuals(spark, d), ["series_id"])
    return out.select("series_id", F.col("lag").cast("long").alias("lag"), off_ties("lb_q").alias("lb_q"), off_ties("lb_p", 6).alias("lb_p"), off_ties("lm").alias("lm"), off_ties("lm_p", 6).alias("lm_p"), off_ties("f", 5).alias("f"))


def change_points(spark, d):
    out = E.change_points(monthly_orders(spark, d).select("series_id", F.col("month").alias("ts"), "value"), ["series_id"])
    return out.select("series_id", "multiplier", F.col("break_idx").cast("long").alias("break_idx"))


def distribution_fits(spark, d):
    return E.fits(events(spark, d), ["series_id"])


def quantile_pairs(spark, d):
    return E.qq_points(events(spark, d), ["series_id"])


def _peaks(spark, d):
    u = events(spark, d).groupBy("series_id").agg(F.percentile("value", 0.9).alias("threshold"))
    return E.declustered_peaks(events(spark, d), u, 5), u


def storm_peaks(spark, d):
    return _peaks(spark, d)[0].select("series_id", F.unix_micros("ts").alias("us"), "peak")


def extreme_fits(spark, d):
    out = E.gpd(*_peaks(spark, d))
    return out.select("series_id", "n_peaks", off_ties("xi", 3).alias("xi"), off_ties("sigma", 2).alias("sigma"), off_ties("ks").alias("ks"), "few")


def extreme_intervals(spark, d):
    p, u = _peaks(spark, d)
    return E.gpd_bootstrap(p.join(u, "series_id").select("series_id", (F.col("peak") - F.col("threshold")).alias("value")).where("value > 0"))


def resampled_intervals(spark, d):
    return E.weibull_bootstrap(events(spark, d), ["series_id"], 24)


def largest_left_out(spark, d):
    out = E.jackknife_max(events(spark, d), ["series_id"])
    return out.select("series_id", off_ties("shape", 6).alias("shape"), off_ties("shape_without_max", 6).alias("shape_without_max"), off_ties("shape_change_pct", 5).alias("shape_change_pct"), off_ties("scale_change_pct", 5).alias("scale_change_pct"))


def regimes(spark, d):
    got = ML.regimes(events(spark, d).select("series_id", "ts", "value"), ["value"])
    return got.groupBy("series_id", "regime", "regime_name").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def regime_shares(spark, d):
    e = with_micros(events(spark, d)).withColumn("label", F.when(F.col("value") > 60, 2).when(F.col("value") > 20, 1).otherwise(0))
    lab = segments.segments_by_gap(e.drop("us"), 4 * HOUR_US).withColumn("us", F.unix_micros("ts"))
    return E.share_bootstrap(lab.select("series_id", "seg_id", "us", "label"), 24)


def regime_moves(spark, d):
    e = with_micros(events(spark, d)).withColumn("regime", F.when(F.col("value") > 60, 2).when(F.col("value") > 20, 1).otherwise(0))
    out = ML.transition_counts(e, ["series_id"])
    return out.select(F.col("from").cast("long").alias("before"), F.col("to").cast("long").alias("after"), "n", off_ties("share", 8).alias("share"))


def hidden_regimes(spark, d):
    return E.hidden_regimes(_segments(spark, d).select("series_id", "seg_id", "ts", "value"))


def components(spark, d):
    return ML.principal_components(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def fingerprints(spark, d):
    f = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("series_id")).agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    return ML.fingerprint_clusters(f, ["m", "s", "n"])


def station_clusters(spark, d):
    return ML.linkage_clusters(stats.pairwise_correlation(_nation_days(spark, d)).select("a", "b", "r"))


def exceedance_forecast(spark, d):
    rows = _indexed(spark, d)
    u = rows.groupBy("series_id").agg(F.percentile("value", 0.9).alias("threshold"))
    f = windows.exceedance_label(windows.exceedance_features(rows.join(u, "series_id")), 6).where("value is not null")
    return FC.brier(ML.exceedance_model(f, ["level", "trend", "volatility"]), ["series_id"])


def order_search(spark, d):
    return E.order_search(_longest(spark, d).select("series_id", "ts", "idx", "value"))


def _backtest(spark, d, **extra):
    return E.arma_backtest(_longest(spark, d).select("series_id", "idx", "ts", "value"), 1, 1, [1, 3, 6], 100, 10, 96, **extra)


def arma_backtest(spark, d):
    return _backtest(spark, d)


def garch_backtest(spark, d):
    return _backtest(spark, d, garch=True)


def interval_quality(spark, d):
    return FC.interval_coverage(_backtest(spark, d))


def driven_backtest(spark, d):
    s = _longest(spark, d).withColumn("drive", F.sin(F.col("us") / F.lit(HOUR_US) * 0.2618))
    return E.arma_backtest(s.select("series_id", "idx", "ts", "value", "drive"), 1, 0, [1, 3], 100, 10, 96, exog="drive", exog_lag=1)


_PK = f"{_GRID}, pk AS (SELECT series_id, h, value, row_number() OVER (PARTITION BY series_id ORDER BY h) - 1 AS j, avg(value) OVER (PARTITION BY series_id) AS m, count(*) OVER (PARTITION BY series_id) AS n FROM grid WHERE value IS NOT NULL), vv AS (SELECT series_id, sum((value - m) * (value - m)) AS ss FROM pk GROUP BY series_id), ac AS (SELECT x.series_id, k.lag, any_value(x.n) AS n, sum((x.value - x.m) * (y.value - y.m)) / any_value(ss) AS rho FROM pk x JOIN range(1, 25) k(lag) ON true JOIN pk y ON x.series_id = y.series_id AND y.j = x.j + k.lag JOIN vv ON vv.series_id = x.series_id GROUP BY x.series_id, k.lag)"
_PAIRS = f"{_GRID}, pr AS (SELECT a.series_id AS a, b.series_id AS b, a.value AS x, b.value AS y FROM grid a JOIN grid b ON a.h = b.h AND a.series_id < b.series_id WHERE a.value IS NOT NULL AND b.value IS NOT NULL)"
_RANK = lambda part, col: f"rank() OVER (PARTITION BY {part} ORDER BY {col}) + (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0"
_TREND = "tp AS (SELECT o_orderpriority AS series_id, year(o_orderdate) * 12 + month(o_orderdate) AS t, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / (100 * count(*)) AS v FROM orders GROUP BY ALL)"
_CCF = f"{_GRID}, wi AS (SELECT h, max(CASE WHEN series_id = 'view' THEN value END) AS view, max(CASE WHEN series_id = 'click' THEN value END) AS click, row_number() OVER (ORDER BY h) AS j FROM grid WHERE series_id IN ('view', 'click') GROUP BY h), cc AS (SELECT k.lag, count(*) AS n, corr(x.view, y.click) AS r FROM wi x JOIN range(-12, 13) k(lag) ON true JOIN wi y ON y.j = x.j + k.lag WHERE x.view IS NOT NULL AND y.click IS NOT NULL GROUP BY k.lag)"
_BT = f"""{_GRID}, hv AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER w AS li, last_value(value IGNORE NULLS) OVER w AS lv, avg(value) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS m FROM idx WINDOW w AS (PARTITION BY series_id ORDER BY i)),
bt AS (SELECT o.series_id, o.i AS origin_idx, k.h AS horizon, t.value AS actual, o.lv AS predicted, t.value - o.lv AS error, t.value - o.m AS merror FROM hv o JOIN (VALUES (1::BIGINT), (3), (6)) k(h) ON true JOIN idx t ON t.series_id = o.series_id AND t.i = o.i + k.h WHERE o.i >= 24 AND (o.i - 24) % 5 = 0 AND o.i - o.li <= 3 AND t.value IS NOT NULL)"""
_SCORED = "sc AS (SELECT series_id, (value > u)::INT AS label, round(b / top * 1000) / 1000 AS p FROM (SELECT event_type AS series_id, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS b FROM events) JOIN (SELECT event_type AS series_id, quantile_cont(value, 0.9) AS u, max(value) AS top FROM events GROUP BY 1) USING (series_id) WHERE b IS NOT NULL)"
_OVER = "u AS (SELECT event_type AS series_id, quantile_cont(value, 0.95) AS u FROM events GROUP BY 1), ov AS (SELECT u.series_id, u.u, count(*) AS n, avg(value - u.u) AS me FROM events e JOIN u ON e.event_type = u.series_id WHERE value > u.u GROUP BY ALL)"
_NDAYS = "nd AS (SELECT c_nationkey::BIGINT AS series_id, date_trunc('month', o_orderdate) AS ts, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / (100 * count(*)) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), np AS (SELECT a.series_id AS a, b.series_id AS b, count(*) AS n, corr(a.value, b.value) AS r FROM nd a JOIN nd b ON a.ts = b.ts AND a.series_id < b.series_id GROUP BY ALL HAVING count(*) >= 20)"

STATS: dict[str, tuple[Query, str | None]] = {
    "tumbling_three_hours": (tumbling_three_hours, "SELECT event_type AS series_id, epoch_us(ts) // 10800000000 * 10800000000 AS start_us, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / (100 * count(*)) AS mean, max(value) AS max FROM events GROUP BY ALL"),
    "annual_statistics": (annual_statistics, f"SELECT year(o_orderdate) AS year, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / (100 * count(*)) AS mean, {_R4('quantile_cont(o_totalprice, 0.95)')} AS p95, median(o_totalprice) AS median FROM orders GROUP BY 1"),
    "monthly_profile": (monthly_profile, f"WITH {MONTHS} SELECT series_id, strftime(month, '%Y-%m') AS month, {_R4('value', 2)} AS value, was_missing FROM mp"),
    "seasonal_extremes": (seasonal_extremes, f"WITH {MONTHS}, b AS (SELECT series_id, month(month) AS m, {_R4('avg(value)', 2)} AS v FROM mp GROUP BY ALL) SELECT series_id, first(m ORDER BY v DESC, m) AS peak, first(m ORDER BY v, m) AS trough FROM b GROUP BY series_id"),
    "yearly_coverage": (yearly_coverage, f"WITH d AS (SELECT DISTINCT o_orderpriority AS series_id, o_orderdate::DATE AS dd FROM orders), y AS (SELECT series_id, year(dd) AS year, count(*) AS valid, count(CASE WHEN month(dd) IN (10, 11, 12, 1, 2, 3) THEN 1 END) AS storm_valid FROM d GROUP BY ALL), l AS (SELECT *, make_date(year + 1, 1, 1) - make_date(year, 1, 1) AS len FROM y) SELECT series_id, year, valid, {_R4('floor(1000.0 * valid / len + 0.5) / 10', 1)} AS pct, storm_valid, {_R4('floor(1000.0 * storm_valid / (len - 183) + 0.5) / 10', 1)} AS storm_pct, year = min(year) OVER (PARTITION BY series_id) OR year = max(year) OVER (PARTITION BY series_id) AS boundary FROM l"),
    "value_shares": (value_shares, "SELECT event_type, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM events GROUP BY 1"),
    "moments": (moments, f"SELECT l_returnflag, {_R4('var_samp(l_quantity)', 6)} AS var_samp, {_R4('var_pop(l_quantity)', 6)} AS var_pop, {_R4('covar_samp(l_quantity, l_extendedprice)', 2)} AS cov, {_R4('corr(l_quantity, l_extendedprice)', 8)} AS r, {_R4('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {_R4('regr_r2(l_extendedprice, l_quantity)', 8)} AS r2, {_R4('regr_r2(l_extendedprice, l_quantity * l_quantity)', 8)} AS r2_square, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1"),
    "imputed": (imputed, "WITH o AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / (100 * count(*)) AS x FROM orders GROUP BY 1), c AS (SELECT c_custkey, x FROM customer LEFT JOIN o ON c_custkey = o_custkey), m AS (SELECT sum(CAST(round(x * 100) AS BIGINT))::DOUBLE / (100 * count(x)) AS m, sum((x IS NULL)::INT)::DOUBLE / count(*) AS missing FROM c) SELECT c_custkey, coalesce(x, m) AS x, missing FROM c, m"),
    "pairwise_correlation": (pairwise_correlation, f"WITH {_PAIRS} SELECT a, b, count(*) AS n, {_R4('CASE WHEN count(*) >= 20 THEN corr(x, y) END', 8)} AS r FROM pr GROUP BY a, b"),
    "rank_correlation": (rank_correlation, f"WITH {_PAIRS}, rk AS (SELECT a, b, {_RANK('a, b', 'x')} AS rx, {_RANK('a, b', 'y')} AS ry FROM pr) SELECT a, b, count(*) AS n, {_R4('CASE WHEN count(*) >= 20 THEN corr(rx, ry) END', 8)} AS r FROM rk GROUP BY a, b"),
    "correlation_by_distance": (correlation_by_distance, f"WITH {_NDAYS}, k AS (SELECT r, 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b * 3.0 - a * 3.0) / 2), 2) + cos(radians(a * 3.0 - 30)) * cos(radians(b * 3.0 - 30)) * pow(sin(radians(b * 7.0 - a * 7.0) / 2), 2)))) AS km FROM np), q AS (SELECT r, km, {_RANK('1', 'km')} AS rk, {_RANK('1', 'r')} AS rr FROM k) SELECT count(*) AS pairs, {_R4('corr(rk, rr)', 6)} AS spearman, {_R4('regr_slope(r, km) * 1000', 6)} AS slope, {_R4('regr_intercept(r, km)', 6)} AS intercept FROM q"),
    "correlation_intervals": (correlation_intervals, f"WITH {_PAIRS}, cr AS (SELECT a, b, count(*) AS n, corr(x, y) AS r FROM pr GROUP BY a, b), m1 AS (SELECT series_id, avg(value) AS m, sum(value * value) AS s2, count(value) AS c FROM grid GROUP BY series_id), d1 AS (SELECT g.series_id, sum((g.value - m) * (g.value - m)) AS ss FROM grid g JOIN m1 USING (series_id) GROUP BY g.series_id), a1 AS (SELECT x.series_id, sum((x.value - m) * (y.value - m)) / any_value(ss) AS r1 FROM idx x JOIN idx y ON x.series_id = y.series_id AND y.i = x.i + 1 JOIN m1 ON m1.series_id = x.series_id JOIN d1 ON d1.series_id = x.series_id GROUP BY x.series_id), e AS (SELECT a, b, r, greatest(4, n * (1 - p.r1 * q.r1) / (1 + p.r1 * q.r1)) AS ne FROM cr JOIN a1 p ON a = p.series_id JOIN a1 q ON b = q.series_id) SELECT a, b, {_R4('ne')} AS n_effective, {_R4('tanh(atanh(r) - 1.96 / sqrt(ne - 3))', 6)} AS ci_low, {_R4('tanh(atanh(r) + 1.96 / sqrt(ne - 3))', 6)} AS ci_high FROM e"),
    "lagged_correlation": (lagged_correlation, f"WITH {_CCF} SELECT lag, n, {_R4('CASE WHEN n > 10 THEN r END', 8)} AS r FROM cc"),
    "strongest_lag": (strongest_lag, f"WITH {_CCF} SELECT lag, {_R4('r', 8)} AS r FROM cc WHERE n > 10 ORDER BY abs(r) DESC, lag LIMIT 1"),
    "autocorrelation": (autocorrelation, f"WITH {_PK} SELECT series_id, lag, {_R4('rho', 8)} AS rho FROM ac"),
    "ljung_box": (ljung_box, f"WITH {_PK} SELECT series_id, k.lags, {_R4('any_value(n) * (any_value(n) + 2) * sum(rho * rho / (n - lag))')} AS q FROM ac JOIN (VALUES (6::BIGINT), (12), (24)) k(lags) ON lag <= k.lags GROUP BY series_id, k.lags"),
    "kendall_trend": (kendall_trend, f"WITH {_TREND}, p AS (SELECT a.series_id, sign(b.v - a.v) AS sg, (b.v - a.v) / (b.t - a.t) AS sl FROM tp a JOIN tp b ON a.series_id = b.series_id AND a.t < b.t), s AS (SELECT series_id, sum(sg)::BIGINT AS s, median(sl) AS sen FROM p GROUP BY 1), n AS (SELECT series_id, count(*) AS n FROM tp GROUP BY 1) SELECT series_id, n, s, {_R4('(s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0)', 6)} AS z, {_R4('sen')} AS sen_slope FROM s JOIN n USING (series_id)"),
    "trend_correction": (trend_correction, f"WITH {_TREND}, r AS (SELECT series_id, t, {_RANK('series_id', 'v')} AS rk, row_number() OVER (PARTITION BY series_id ORDER BY t) AS j, count(*) OVER (PARTITION BY series_id) AS n FROM tp), z AS (SELECT *, rk - (n + 1) / 2.0 AS z FROM r), d AS (SELECT series_id, sum(z * z) AS d FROM z GROUP BY 1), c AS (SELECT x.series_id, x.n, y.j - x.j AS lag, sum(x.z * y.z) / any_value(d) AS rho FROM z x JOIN z y ON x.series_id = y.series_id AND y.j > x.j JOIN d ON d.series_id = x.series_id GROUP BY ALL) SELECT series_id, {_R4('greatest(1, 1 + 2.0 / (any_value(n) * (any_value(n) - 1) * (any_value(n) - 2)) * coalesce(sum(CASE WHEN lag <= n - 2 AND rho > (-1 + 1.96 * sqrt(n - 2)) / (n - 1) THEN (n - lag) * (n - lag - 1) * (n - lag - 2) * rho END), 0))', 6)} AS correction FROM c GROUP BY series_id"),
    "residual_life": (residual_life, f"WITH q AS (SELECT event_type AS series_id, quantile_cont(value, 0.8) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1), t AS (SELECT series_id, k, lo + (hi - lo) * k / 24 AS u FROM q, range(0, 25) r(k)), g AS (SELECT t.series_id, k, u, count(*) AS n, avg(value - u) AS me, stddev_samp(value - u) AS sd FROM events e JOIN t ON e.event_type = t.series_id AND value > u GROUP BY ALL) SELECT series_id, k, {_R4('u', 6)} AS threshold, n, {_R4('CASE WHEN n >= 5 THEN me END', 6)} AS mean_excess, {_R4('CASE WHEN n >= 5 THEN sd / sqrt(n) END', 6)} AS se FROM g"),
    "uniform_distance": (uniform_distance, f"WITH r AS (SELECT event_type AS series_id, value, max(value) OVER (PARTITION BY event_type) AS top, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i FROM events) SELECT series_id, n, {_R4('max(greatest(i::DOUBLE / n - value / top, value / top - (i - 1)::DOUBLE / n))', 8)} AS ks FROM r GROUP BY series_id, n"),
    "over_threshold": (over_threshold, f"WITH {_OVER} SELECT series_id, u, n, {_R4('me', 6)} AS mean_excess FROM ov"),
    "return_levels": (return_levels, f"WITH {_OVER}, y AS (SELECT event_type AS series_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 31557600000000.0::DOUBLE AS years FROM events GROUP BY 1), q AS (SELECT ov.series_id, u, {_R4('me', 6)} AS s, n / years AS pr FROM ov JOIN y USING (series_id)) SELECT series_id, y AS years, xi, {_R4('CASE WHEN xi = 0 THEN u + s * ln(pr * y) ELSE u + s / xi * (pow(pr * y, xi) - 1) END')} AS level FROM q, (VALUES (1.0::DOUBLE), (10.0::DOUBLE), (50.0::DOUBLE)) a(y), (VALUES (0.0::DOUBLE), (-0.1::DOUBLE), (0.2::DOUBLE)) b(xi)"),
    "without_largest": (without_largest, "SELECT series_id, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / (100 * count(*)) AS mean, max(value) AS max FROM (SELECT event_type AS series_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts) AS r FROM events) WHERE r > 1 GROUP BY 1"),
    "histogram": (histogram, "SELECT series_id, least(floor((value - lo) / (hi - lo) * 40), 39)::BIGINT AS bin, count(*) AS n FROM (SELECT event_type AS series_id, value, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events) GROUP BY ALL"),
    "fourier_power": (fourier_power, f"WITH {_GRID}, m AS (SELECT series_id, avg(value) AS m FROM grid GROUP BY 1) SELECT g.series_id, p.per AS period_hours, {_R4('(pow(sum((value - m) * cos(h * 6.283185307179586 / p.per)), 2) + pow(sum((value - m) * sin(h * 6.283185307179586 / p.per)), 2)) / count(*)')} AS power FROM grid g JOIN m USING (series_id), (VALUES (6.0::DOUBLE), (12.0::DOUBLE), (12.4206::DOUBLE), (24.0::DOUBLE)) p(per) WHERE value IS NOT NULL GROUP BY g.series_id, p.per"),
    "persistence_backtest": (persistence_backtest, f"WITH {_BT} SELECT series_id, origin_idx, horizon, actual, predicted, error FROM bt"),
    "persistence_summary": (persistence_summary, f"WITH {_BT} SELECT series_id, horizon, count(*) AS n, {_R4('sqrt(avg(error * error))', 6)} AS rmse, {_R4('avg(abs(error))', 6)} AS mae FROM bt GROUP BY ALL"),
    "forecast_skill": (forecast_skill, f"WITH {_BT} SELECT series_id, horizon, {_R4('1 - avg(merror * merror) / avg(error * error)', 6)} AS skill FROM bt GROUP BY ALL"),
    "brier_scores": (brier_scores, f"WITH {_SCORED}, b AS (SELECT series_id, count(*) AS n, avg(pow(p - label, 2)) AS b, avg(label) * (1 - avg(label)) AS base FROM sc GROUP BY 1) SELECT series_id, n, {_R4('b', 8)} AS brier, {_R4('base', 8)} AS baseline, {_R4('1 - b / base', 6)} AS skill FROM b"),
    "ranking_quality": (ranking_quality, f"WITH {_SCORED}, r AS (SELECT series_id, label, {_RANK('series_id', 'p')} AS rk FROM sc) SELECT series_id, {_R4('(sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label))', 8)} AS auc FROM r GROUP BY 1"),
    "regime_moves": (regime_moves, "WITH l AS (SELECT event_type AS series_id, ts, CASE WHEN value > 60 THEN 2 WHEN value > 20 THEN 1 ELSE 0 END::BIGINT AS r FROM events), m AS (SELECT r AS after, lag(r) OVER (PARTITION BY series_id ORDER BY ts) AS before FROM l), c AS (SELECT before, after, count(*) AS n FROM m WHERE before IS NOT NULL GROUP BY ALL) SELECT before, after, n, " + _R4("n::DOUBLE / sum(n) OVER (PARTITION BY before)", 8) + " AS share FROM c"),
    **{f.__name__: (f, ESTIMATOR_SQL[f.__name__]) for f in (
        harmonic_residuals, spectra, spectral_ratios, dominant_period, power_transform, partial_autocorrelation, timescales, dependence, stationarity, whiteness, change_points, storm_peaks, extreme_fits, largest_left_out)},
    **{f.__name__: (f, None) for f in (
        singular_spectrum, seasonal_decomposition, seasonal_shares, distribution_fits, quantile_pairs, extreme_intervals, resampled_intervals, regimes, regime_shares, hidden_regimes, components, fingerprints,
        station_clusters, exceedance_forecast, order_search, arma_backtest, garch_backtest, interval_quality, driven_backtest)},
}
