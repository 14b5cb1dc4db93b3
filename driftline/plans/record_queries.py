"""Queries over whole records: regular grids of two sampling rates with their reports, catalogs, intervals, matched baselines, wind coupling; each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import estimators as E
from ..operators import forecast as FC
from ..operators import joins, regularize, stats, windows
from ..operators.ordered import Ordered, with_micros
from ..sources import tables
from ..session import materialized
from ..sources.tables import table
from .estimator_sql import _SPECTRA
from .series_queries import _R4, HOUR_US, Query, _indexed, events, mean_of_cents, off_ties
from .stat_queries import _BT, _spectra

BOUNDS, ERA_SAMPLES = (0.0, 120.0), 12
DAY_US = 24 * HOUR_US
#: Grid cells of the raster and places of the stations, in degrees.
CELLS = ((0.0, 0.0), (0.0, 20.0), (10.0, 0.0), (10.0, 20.0))
STATIONS = (("error", 1.0, 3.0), ("purchase", 6.0, 12.0), ("signup", 9.0, 17.0))


def two_rates(spark, d):
    """series_id, ts, value: hourly means in the first half of the record, three-hourly ones in the second."""
    e = with_micros(events(spark, d))
    cut = e.agg((F.floor((F.min("us") + F.max("us")) / 2 / DAY_US) * DAY_US).cast("long").alias("cut"))
    step = F.when(F.col("us") < F.col("cut"), HOUR_US).otherwise(3 * HOUR_US)
    bins = e.crossJoin(F.broadcast(cut)).groupBy("series_id", (F.floor(F.col("us") / step) * step).cast("long").alias("us")).agg(mean_of_cents("value").alias("value"))
    return bins.select("series_id", F.timestamp_micros("us").alias("ts"), "value")


def _regular(spark, d):
    return regularize.regularize(two_rates(spark, d), BOUNDS, ERA_SAMPLES)


def regularized(spark, d):
    grid, _ = _regular(spark, d)
    return grid.select("series_id", F.col("era_id").cast("long").alias("era_id"), F.unix_micros("ts").alias("us"), off_ties("value", 6).alias("value"), "is_interpolated", "is_marker")


def era_report(spark, d):
    _, report = _regular(spark, d)
    counts = [c for c in report.columns if c.startswith("n_") or c == "longest_gap_samples"]
    return report.select("series_id", F.col("era_id").cast("long").alias("era_id"), "freq_us", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), *counts, off_ties("longest_gap_hours", 2).alias("longest_gap_hours"))


def record_summary(spark, d):
    grid, report = _regular(spark, d)
    out = regularize.record_report(report, grid)
    numbers = {"longest_gap_hours": 2, "pct_missing_after_clean": 6, "record_years": 8, "sampling_interval_hours": 4}
    return out.select(*(off_ties(c, numbers[c]).alias(c) if c in numbers else F.col(c) for c in out.columns))


def file_catalog(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    files = n.select(F.concat(F.lit("/data/"), "n_name", F.lit("_S"), k.cast("string"), F.lit(".nc")).alias("path"), (k * 3.0 - 30).alias("lat"), (k * 7.0 - 80).alias("lon"))
    return tables.geofenced(files, (-20.0, 25.0), (-60.0, 60.0))


def shifted_values(spark, d):
    c = table(spark, d, "customer").withColumn("least", F.min("c_acctbal").over(Window.partitionBy("c_nationkey")))
    return c.select("c_custkey", off_ties(S.shift_to_positive(F.col("c_acctbal"), F.col("least")), 6).alias("shifted"), off_ties(S.shift_to_positive(F.col("c_acctbal"), F.col("least"), always=True), 6).alias("always"))


def _persisted(spark, d, horizons, step):
    return FC.persistence(_indexed(spark, d), horizons, step, 24, 3)


def interval_hits(spark, d):
    """How often a band of 1.96 deviations of the series holds the persistence forecast's target."""
    sd = _indexed(spark, d).groupBy("series_id").agg((1.96 * F.stddev_pop("value")).alias("half_width"))
    out = FC.interval_coverage(_persisted(spark, d, [1, 3, 6], 5).withColumnRenamed("horizon_samples", "horizon").join(sd, "series_id"))
    return out.select("series_id", F.col("horizon").cast("long").alias("horizon"), off_ties("coverage", 8).alias("coverage"), off_ties("mean_width", 5).alias("mean_width"))


def matched_baseline(spark, d):
    """Persistence errors at the origins and horizons of a sparser backtest only."""
    sparse = _persisted(spark, d, [3, 6], 10).withColumnRenamed("horizon_samples", "horizon")
    out = FC.local_baseline(sparse, _persisted(spark, d, [1, 3, 6], 5))
    return out.select("series_id", "origin_idx", F.col("horizon_samples").cast("long").alias("horizon"), "error")


def _mean_skill(spark, d, rows):
    m = windows.trailing_rows(_indexed(spark, d), rows, {"m": F.avg("value")}).select("series_id", F.col("idx").alias("origin_idx"), "m")
    base = _persisted(spark, d, [1, 3, 6], 5)
    model = base.join(m, ["series_id", "origin_idx"]).withColumn("error", F.col("actual") - F.col("m"))
    return FC.skill(FC.summarize(model, 1.0), FC.summarize(base, 1.0))


def skill_deltas(spark, d):
    """Skill of two forecasts by trailing means, of 24 and of 12 rows, and what the shorter one adds."""
    keys = ["series_id", "horizon_samples"]
    both = _mean_skill(spark, d, 24).join(_mean_skill(spark, d, 12).withColumnRenamed("skill", "short"), keys)
    return both.select("series_id", F.col("horizon_samples").cast("long").alias("horizon"), off_ties("skill", 6).alias("skill"), off_ties("short", 6).alias("skill_short"), off_ties(F.col("short") - F.col("skill"), 6).alias("delta"))


def replicate_counts(spark, d):
    n = events(spark, d).groupBy("series_id").agg(F.count("value").alias("n"))
    return n.select("series_id", "n", S.replicates(F.col("n")).alias("replicates"))


def _raster(spark, d):
    """ts, lat, lon, u10, v10 every three hours on CELLS: two series about their means stand for the parts of the wind."""
    e = events(spark, d).where("series_id in ('view', 'click')")
    us = F.floor(F.unix_micros("ts") / (3 * HOUR_US)) * (3 * HOUR_US)
    by = e.groupBy(F.timestamp_micros(us.cast("long")).alias("ts")).pivot("series_id", ["view", "click"]).agg(mean_of_cents("value")).dropna()
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in CELLS))).alias("c")
    rows = by.select("ts", "view", "click", cells).select("ts", "view", "click", "c.lat", "c.lon")
    return rows.select("ts", "lat", "lon", ((F.col("view") - 50) * (1 + F.col("lat") / 100)).alias("u10"), ((F.col("click") - 50) * (1 + F.col("lon") / 100)).alias("v10"))


def station_winds(spark, d):
    """The raster at each station: parts, speed and direction of the wind in bins met with the station's own means."""
    stations = spark.createDataFrame(list(STATIONS), "series_id string, lat double, lon double")
    wind = tables.raster_at_stations(_raster(spark, d), stations)
    out = joins.binned_with_raster(events(spark, d).select("series_id", "ts", "value"), wind)
    return out.select("series_id", F.unix_micros("ts").alias("us"), off_ties("value").alias("value"), "n", off_ties("wind_speed").alias("wind_speed"), off_ties("wind_from").alias("wind_from"))


def wind_coupling(spark, d):
    """How each station follows the wind: strongest lag, explained variance of speed and of its square, and the better form."""
    stations = spark.createDataFrame(list(STATIONS), "series_id string, lat double, lon double")
    met = joins.binned_with_raster(events(spark, d).select("series_id", "ts", "value"), tables.raster_at_stations(_raster(spark, d), stations))
    rows = Ordered(with_micros(met), ["series_id"]).index("idx").done()
    lag = stats.best_lag(stats.cross_correlation(rows, "wind_speed", "value", 8), ["series_id"])
    w = F.col("wind_speed")
    fit = met.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.regr_r2("value", "wind_speed").alias("r2"), F.regr_r2(F.col("value"), w * w).alias("r2_square"))
    out = fit.join(lag, "series_id")
    return out.select(
        "series_id", "n", (F.col("lag") * 3).cast("long").alias("lag_hours"), off_ties("r", 7).alias("r"), off_ties("r2", 8).alias("r2"), off_ties("r2_square", 8).alias("r2_square"),
        F.when(F.col("r2_square") > F.col("r2"), "square").otherwise("linear").alias("form"), F.rank().over(Window.orderBy(F.desc(F.greatest("r2", "r2_square")))).cast("long").alias("place"),
    )


#: Bands of a spectrum: name, period and half width of the peak, periods of the floor, what is left out of it.
BANDS = (("diurnal", 24.0, 1.0, (6.0, 48.0), ((24.0, 1.0),)), ("M2", 12.4206, 0.3, (8.0, 18.0), ((12.4206, 0.3), (12.0, 0.2))), ("S2", 12.0, 0.2, (8.0, 18.0), ((12.4206, 0.3), (12.0, 0.2))))


def band_ratios(spark, d):
    """Peak over floor of three bands of each longest stretch's spectrum."""
    spectrum = materialized(_spectra(spark, d), "spectra")
    out = None
    for name, centre, width, base, excluded in BANDS:
        one = E.peak_over_baseline(spectrum, ["series_id"], centre, width, base, list(excluded)).select("series_id", F.lit(name).alias("band"), off_ties("ratio", 6).alias("ratio"))
        out = one if out is None else out.unionByName(one)
    return out


def high_trend(spark, d):
    """Trend of the yearly 95th percentile of orders, for records of five years and more."""
    o = table(spark, d, "orders")
    by = o.groupBy(F.col("o_orderpriority").alias("series_id"), F.year("o_orderdate").cast("long").alias("t")).agg(off_ties(F.percentile("o_totalprice", 0.95), 4).alias("value"))
    long = by.groupBy("series_id").agg((F.max("t") - F.min("t") + 1).alias("years")).where("years >= 5").select("series_id")
    out = stats.kendall_s(by.join(long, "series_id", "left_semi"))
    return out.select("series_id", "n", "s", off_ties("z", 6).alias("z"), off_ties("sen_slope", 3).alias("sen_slope"))


def covariance_matrix(spark, d):
    """Sample covariances of all pairs of four variables, from one aggregation."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    row = table(spark, d, "lineitem").agg(*(F.covar_samp(a, b).alias(f"{a}|{b}") for a in names for b in names))
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("cov")) for a in names for b in names))).alias("p")
    return row.select(pairs).select("p.a", "p.b", off_ties("p.cov", 3).alias("cov"))


_TWO = f"""cut AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 // {DAY_US} * {DAY_US} AS c FROM events),
sm AS (SELECT event_type AS series_id, CASE WHEN epoch_us(ts) < c THEN epoch_us(ts) // {HOUR_US} * {HOUR_US} ELSE epoch_us(ts) // {3 * HOUR_US} * {3 * HOUR_US} END AS us, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / (100 * count(*)) AS value FROM events, cut GROUP BY ALL),
ix AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY us) - 1 AS i, (us - lag(us) OVER (PARTITION BY series_id ORDER BY us)) // 60000000 AS minutes FROM sm),
st AS (SELECT series_id, i - 1 AS step, minutes FROM ix WHERE minutes IS NOT NULL),
ch AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY step) AS run FROM (SELECT *, CASE WHEN minutes IS DISTINCT FROM lag(minutes) OVER (PARTITION BY series_id ORDER BY step) THEN 1 ELSE 0 END AS new FROM st)),
cf AS (SELECT series_id, run, minutes, count(*) AS n, min(step) AS first_idx, max(step) AS last_idx FROM ch GROUP BY ALL HAVING count(*) >= {ERA_SAMPLES}),
e1 AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY first_idx) AS era_id FROM (SELECT *, CASE WHEN minutes IS DISTINCT FROM lag(minutes) OVER (PARTITION BY series_id ORDER BY first_idx) THEN 1 ELSE 0 END AS new FROM cf)),
e2 AS (SELECT series_id, era_id, min(minutes) AS minutes, max(last_idx) AS last_step FROM e1 GROUP BY ALL),
nn AS (SELECT series_id, count(*) AS total FROM sm GROUP BY 1),
e3 AS (SELECT e2.*, CASE WHEN lead(era_id) OVER w IS NULL THEN total ELSE last_step + 2 END AS to_idx FROM e2 JOIN nn USING (series_id) WINDOW w AS (PARTITION BY e2.series_id ORDER BY era_id)),
md AS (SELECT series_id, minutes FROM (SELECT series_id, minutes, row_number() OVER (PARTITION BY series_id ORDER BY count(*) DESC, minutes) AS r FROM st GROUP BY series_id, minutes) WHERE r = 1),
er AS (SELECT series_id, era_id, coalesce(lag(to_idx) OVER (PARTITION BY series_id ORDER BY era_id), 0) AS from_idx, to_idx, minutes * 60000000 AS freq FROM e3
 UNION ALL SELECT nn.series_id, 1, 0, total, md.minutes * 60000000 FROM nn LEFT JOIN md USING (series_id) WHERE nn.series_id NOT IN (SELECT series_id FROM e2)),
tg AS (SELECT ix.series_id, era_id, us, value, freq, us // freq AS q, us % freq AS r FROM ix JOIN er ON ix.series_id = er.series_id AND i >= from_idx AND i < to_idx),
sn AS (SELECT series_id, era_id, freq, (q + CASE WHEN 2 * r > freq OR (2 * r = freq AND q % 2 = 1) THEN 1 ELSE 0 END) * freq AS slot, arg_min(value, us) AS value, count(*) - 1 AS collisions FROM tg GROUP BY ALL),
gs AS (SELECT series_id, era_id, freq, unnest(range(lo, hi + 1, freq)) AS slot FROM (SELECT series_id, era_id, freq, min(slot) AS lo, max(slot) AS hi FROM sn GROUP BY ALL)),
g0 AS (SELECT gs.*, s.value AS raw, coalesce(s.collisions, 0) AS collisions, CASE WHEN s.value BETWEEN {BOUNDS[0]} AND {BOUNDS[1]} THEN s.value END AS value, row_number() OVER (PARTITION BY gs.series_id, gs.era_id ORDER BY gs.slot) - 1 AS i FROM gs LEFT JOIN sn s ON s.series_id = gs.series_id AND s.era_id = gs.era_id AND s.slot = gs.slot),
g1 AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS li, last_value(value IGNORE NULLS) OVER a AS lv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ri, first_value(value IGNORE NULLS) OVER b AS rv, max(i) OVER (PARTITION BY series_id, era_id) AS top FROM g0
 WINDOW a AS (PARTITION BY series_id, era_id ORDER BY i), b AS (PARTITION BY series_id, era_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g2 AS (SELECT *, CASE WHEN value IS NOT NULL THEN 0 ELSE coalesce(ri - 1, top) - coalesce(li + 1, 0) + 1 END AS gap FROM g1),
g3 AS (SELECT *, value IS NULL AND gap <= 3 AS filled, CASE WHEN value IS NULL AND gap <= 3 AND li IS NOT NULL THEN coalesce(lv + (rv - lv) * (i - li) / (ri - li), lv) ELSE value END AS v FROM g2),
rp AS (SELECT series_id, era_id, freq, min(slot) AS start_us, max(slot) AS end_us, count(*) AS n_samples_regularized, sum(collisions)::BIGINT AS n_snap_collisions, sum((raw IS NULL)::INT)::BIGINT AS n_missing_before_clean, sum((raw IS NOT NULL AND value IS NULL)::INT)::BIGINT AS n_sanity_flagged_bad, sum(filled::INT)::BIGINT AS n_short_gap_interpolated, sum((gap > 3)::INT)::BIGINT AS n_long_gap_left, max(gap)::BIGINT AS longest_gap_samples FROM g3 GROUP BY ALL),
nx AS (SELECT *, lead(start_us) OVER (PARTITION BY series_id ORDER BY era_id) AS next_us FROM rp),
rg AS (SELECT series_id, arg_min(era_id, era_id) AS era_id, slot AS us, arg_min(struct_pack(v := v), era_id).v AS value, arg_min(filled, era_id) AS is_interpolated, false AS is_marker FROM g3 GROUP BY series_id, slot
 UNION ALL SELECT series_id, era_id, end_us + (next_us - end_us) // 2, NULL, false, true FROM nx WHERE next_us > end_us)"""
_HOURS_ = _R4("round(longest_gap_samples * freq / 3600000000.0, 2)", 2)
_PLACED = "sd AS (SELECT * FROM (VALUES ('error', 0.0::DOUBLE, 0.0::DOUBLE), ('purchase', 10.0::DOUBLE, 20.0::DOUBLE), ('signup', 10.0::DOUBLE, 20.0::DOUBLE)) v(series_id, lat, lon))"
_WINDS = f"""{_PLACED}, tb AS (SELECT event_type, epoch_us(ts) // {3 * HOUR_US} * {3 * HOUR_US} AS us, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / (100 * count(*)) AS m, avg(value) AS value, count(value) AS n FROM events GROUP BY ALL),
ra AS (SELECT v.us, (v.m - 50) AS u, (c.m - 50) AS w FROM tb v JOIN tb c ON v.us = c.us AND v.event_type = 'view' AND c.event_type = 'click'),
wd AS (SELECT sd.series_id, ra.us, u * (1 + lat / 100) AS u10, w * (1 + lon / 100) AS v10 FROM ra, sd),
wm AS (SELECT wd.series_id, wd.us, value, n, sqrt(u10 * u10 + v10 * v10) AS speed, degrees(atan2(u10, v10)) + 180 AS a FROM wd JOIN tb ON tb.event_type = wd.series_id AND tb.us = wd.us)"""

_BAND_SQL = " UNION ALL ".join(
    f"SELECT series_id, '{n}' AS band, " + _R4(f"max(CASE WHEN abs(period_hours - {c}) < {w} THEN power END) / median(CASE WHEN period_hours > {lo} AND period_hours < {hi} " + " ".join(f"AND NOT abs(period_hours - {x}) < {y}" for x, y in out) + " THEN power END)", 6) + " AS ratio FROM sp GROUP BY series_id"
    for n, c, w, (lo, hi), out in BANDS
)
_FOUR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_COV_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, " + _R4(f"covar_samp({a}, {b})", 3) + " AS cov FROM lineitem" for a in _FOUR for b in _FOUR)

RECORDS: dict[str, tuple[Query, str | None]] = {
    "regularized": (regularized, f"WITH {_TWO} SELECT series_id, era_id::BIGINT AS era_id, us, {_R4('value', 6)} AS value, is_interpolated, is_marker FROM rg"),
    "era_report": (era_report, f"WITH {_TWO} SELECT series_id, era_id::BIGINT AS era_id, freq AS freq_us, start_us, end_us, n_samples_regularized, n_snap_collisions, n_missing_before_clean, n_sanity_flagged_bad, n_short_gap_interpolated, n_long_gap_left, longest_gap_samples, {_HOURS_} AS longest_gap_hours FROM rp"),
    "record_summary": (record_summary, f"WITH {_TWO}, ea AS (SELECT series_id, first(freq ORDER BY n_samples_regularized DESC, era_id) AS freq, count(*) AS n_eras, sum(n_snap_collisions)::BIGINT AS n_snap_collisions, sum(n_missing_before_clean)::BIGINT AS n_missing_before_clean, sum(n_sanity_flagged_bad)::BIGINT AS n_sanity_flagged_bad, sum(n_short_gap_interpolated)::BIGINT AS n_short_gap_interpolated, sum(n_long_gap_left)::BIGINT AS n_long_gap_left, max(longest_gap_samples) AS longest_gap_samples, max({_HOURS_}) AS longest_gap_hours FROM rp GROUP BY 1), wh AS (SELECT series_id, count(*) AS n_samples_regularized, sum(is_marker::INT)::BIGINT AS marks, {_R4('100 * avg((value IS NULL)::INT)', 6)} AS pct_missing_after_clean, {_R4('(max(us) - min(us)) / 31557600000000.0', 8)} AS record_years FROM rg GROUP BY 1) SELECT series_id, n_eras, n_snap_collisions, n_missing_before_clean, n_sanity_flagged_bad, n_short_gap_interpolated, n_long_gap_left + marks AS n_long_gap_left, longest_gap_samples, longest_gap_hours, n_samples_regularized, marks AS n_era_boundary_markers, pct_missing_after_clean, record_years, n_eras > 1 AS multi_era_detected, {_R4('freq / 3600000000.0')} AS sampling_interval_hours FROM ea JOIN wh USING (series_id)"),
    "band_ratios": (band_ratios, f"WITH {_SPECTRA} {_BAND_SQL}"),
    "high_trend": (high_trend, f"WITH tp AS (SELECT o_orderpriority AS series_id, year(o_orderdate) AS t, {_R4('quantile_cont(o_totalprice, 0.95)')} AS v FROM orders GROUP BY ALL), ok AS (SELECT series_id FROM tp GROUP BY 1 HAVING max(t) - min(t) + 1 >= 5), p AS (SELECT a.series_id, sign(b.v - a.v) AS sg, (b.v - a.v) / (b.t - a.t) AS sl FROM tp a JOIN tp b ON a.series_id = b.series_id AND a.t < b.t), s AS (SELECT series_id, sum(sg)::BIGINT AS s, median(sl) AS sen FROM p GROUP BY 1), n AS (SELECT series_id, count(*) AS n FROM tp GROUP BY 1) SELECT series_id, n, s, {_R4('(s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0)', 6)} AS z, {_R4('sen', 3)} AS sen_slope FROM s JOIN n USING (series_id) WHERE series_id IN (SELECT series_id FROM ok)"),
    "covariance_matrix": (covariance_matrix, _COV_SQL),
    "file_catalog": (file_catalog, "SELECT '/data/' || n_name || '_S' || n_nationkey || '.nc' AS path, n_nationkey * 3.0::DOUBLE - 30 AS lat, n_nationkey * 7.0::DOUBLE - 80 AS lon, 'S' || n_nationkey AS series_id FROM nation WHERE n_nationkey * 3.0 - 30 BETWEEN -20 AND 25 AND n_nationkey * 7.0 - 80 BETWEEN -60 AND 60"),
    "shifted_values": (shifted_values, f"WITH c AS (SELECT c_custkey, c_acctbal AS x, min(c_acctbal) OVER (PARTITION BY c_nationkey) AS lo FROM customer) SELECT c_custkey, {_R4('CASE WHEN lo <= 0 THEN x - lo + 1e-6 ELSE x END', 6)} AS shifted, {_R4('x + greatest(0, -lo) + 1e-6', 6)} AS \"always\" FROM c"),
    "interval_hits": (interval_hits, f"WITH {_BT}, sd AS (SELECT series_id, 1.96 * stddev_pop(value) AS w FROM idx GROUP BY 1) SELECT bt.series_id, horizon, {_R4('avg((abs(error) <= w)::INT)', 8)} AS coverage, {_R4('avg(2 * w)', 5)} AS mean_width FROM bt JOIN sd ON sd.series_id = bt.series_id GROUP BY bt.series_id, horizon"),
    "matched_baseline": (matched_baseline, f"WITH {_BT} SELECT series_id, origin_idx, horizon, error FROM bt WHERE (origin_idx - 24) % 10 = 0 AND horizon IN (3, 6)"),
    "skill_deltas": (skill_deltas, f"WITH {_BT}, sh AS (SELECT series_id, i, avg(value) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS s FROM idx), sk AS (SELECT bt.series_id, horizon, 1 - avg(merror * merror) / avg(error * error) AS a, 1 - avg((actual - s) * (actual - s)) FILTER (WHERE s IS NOT NULL) / avg(error * error) AS b FROM bt JOIN sh ON sh.series_id = bt.series_id AND sh.i = bt.origin_idx GROUP BY ALL) SELECT series_id, horizon, {_R4('a', 6)} AS skill, {_R4('b', 6)} AS skill_short, {_R4('b - a', 6)} AS delta FROM sk"),
    "replicate_counts": (replicate_counts, "SELECT event_type AS series_id, count(value) AS n, CASE WHEN count(value) >= 500000 THEN 200 WHEN count(value) >= 50000 THEN 500 ELSE 1000 END::BIGINT AS replicates FROM events GROUP BY 1"),
    "station_winds": (station_winds, f"WITH {_WINDS} SELECT series_id, us, {_R4('value')} AS value, n, {_R4('speed')} AS wind_speed, {_R4('CASE WHEN a >= 360 THEN a - 360 ELSE a END')} AS wind_from FROM wm"),
    "wind_coupling": (wind_coupling, f"WITH {_WINDS}, wj AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY us) - 1 AS j FROM wm), cc AS (SELECT x.series_id, k.lag, corr(x.speed, y.value) AS r, count(*) AS n FROM wj x JOIN range(-8, 9) k(lag) ON true JOIN wj y ON y.series_id = x.series_id AND y.j = x.j + k.lag GROUP BY ALL), b AS (SELECT series_id, first(lag ORDER BY abs(r) DESC, lag) AS lag, first(r ORDER BY abs(r) DESC, lag) AS r FROM cc WHERE n > 10 GROUP BY 1), f AS (SELECT series_id, count(*) AS n, regr_r2(value, speed) AS r2, regr_r2(value, speed * speed) AS r2s FROM wm GROUP BY 1) SELECT series_id, n, lag * 3 AS lag_hours, {_R4('r', 7)} AS r, {_R4('r2', 8)} AS r2, {_R4('r2s', 8)} AS r2_square, CASE WHEN r2s > r2 THEN 'square' ELSE 'linear' END AS form, rank() OVER (ORDER BY greatest(r2, r2s) DESC) AS place FROM f JOIN b USING (series_id)"),
}
