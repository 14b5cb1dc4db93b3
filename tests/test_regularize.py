"""Known-answer cases with seeded series: rate changes, gaps, jitter, seams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import regularize, segments


def series(index, rng=None, name="s"):
    values = np.clip(1.0 + (rng or np.random.default_rng(0)).normal(0, 0.2, len(index)), 0.05, None)
    return pd.DataFrame({"series_id": name, "ts": index, "value": values})


def run(spark, pdf):
    pdf = pdf.copy()
    pdf["value"] = pdf["value"].astype(object).where(pdf["value"].notna(), None)
    rows = spark.createDataFrame(pdf, "series_id string, ts timestamp, value double")
    grid, report = regularize.regularize(rows)
    return grid.cache(), report.orderBy("era_id").toPandas()


def test_one_era_with_gaps_in_values(spark):
    index = pd.date_range("2005-01-01", "2008-12-31 23:00", freq="h")
    pdf = series(index, np.random.default_rng(11))
    pdf.loc[1000:1001, "value"] = np.nan  # short: filled
    pdf.loc[5000:5008, "value"] = np.nan  # long: stays
    grid, report = run(spark, pdf)
    assert len(report) == 1 and report.freq_us[0] == 3_600_000_000
    assert (report.n_short_gap_interpolated[0], report.n_long_gap_left[0], report.longest_gap_samples[0]) == (2, 9, 9)
    assert grid.count() == len(index) and grid.where("value is null").count() == 9


def test_rate_change_makes_two_eras_and_no_values(spark):
    pdf = pd.concat([series(pd.date_range("2009-01-01", "2009-12-31", freq="15min")), series(pd.date_range("2010-01-01", "2010-12-31", freq="30min"))])
    _, report = run(spark, pdf)
    assert sorted(report.freq_us / 3.6e9) == [0.25, 0.5]
    assert report.n_short_gap_interpolated.sum() == 0


def test_gap_of_one_rate_stays_one_era(spark):
    parts = [pd.date_range("2009-01-01", "2009-06-01", freq="15min"), pd.date_range("2010-01-01", "2010-06-01", freq="15min"), pd.date_range("2010-06-02", "2011-01-01", freq="30min")]
    pdf = pd.concat([series(p) for p in parts])
    grid, report = run(spark, pdf)
    assert len(report) == 2
    hours = (parts[1][0] - parts[0][-1]).total_seconds() / 3600
    assert abs(report.longest_gap_hours[0] - hours) / hours < 0.01
    ends = grid.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    assert abs((ends.b - ends.a) / (parts[2][-1] - parts[0][0]) - 1) < 0.01


def test_jitter_is_snapped(spark):
    rng = np.random.default_rng(31)
    index = pd.date_range("2018-01-01", periods=5000, freq="30min") + pd.to_timedelta(rng.integers(-3, 4, 5000), unit="s")
    grid, report = run(spark, series(index))
    assert grid.where("value is null").count() / grid.count() < 0.01
    assert report.n_snap_collisions[0] >= 0


def test_seam_breaks_contiguity(spark):
    a, b = pd.date_range("2017-06-01", "2017-10-16 09:30", freq="15min"), pd.date_range("2017-10-16 10:15", "2018-03-01", freq="30min")
    grid, _ = run(spark, pd.concat([series(a), series(b)]))
    assert grid.where("is_marker").count() >= 1
    best = segments.longest_segment(grid).first()
    assert not (best.start <= a[-1] and best.end >= b[0])


def test_longest_segment_may_lie_in_the_smaller_era(spark):
    fine = series(pd.date_range("2010-01-01", "2010-12-31", freq="15min"))
    rng = np.random.default_rng(52)
    for at in rng.integers(0, len(fine) - 200, 60):
        fine.loc[at : at + 100, "value"] = np.nan
    coarse = series(pd.date_range("2011-01-01", "2011-09-30", freq="30min"))
    grid, report = run(spark, pd.concat([fine, coarse]))
    best = segments.longest_segment(grid)
    eras = report.rename(columns={"freq_us": "dt_us"})[["series_id", "era_id", "start", "end", "dt_us"]]
    eras = spark.createDataFrame(eras, "series_id string, era_id long, start timestamp, end timestamp, dt_us long")
    got = segments.interval_at(best.select("series_id", F.col("start").alias("ts")), eras).first()
    dominant = report.loc[report.n_samples_regularized.idxmax(), "freq_us"]
    assert got.dt_us == 1_800_000_000 and dominant == 900_000_000


def test_snap_sends_ties_to_even_slots(spark):
    rows = spark.createDataFrame([("00:15",), ("00:45",), ("00:14",)], "t string").select(F.unix_micros(F.to_timestamp(F.concat(F.lit("2020-01-01 "), "t"))).alias("us"))
    got = rows.select(F.timestamp_micros(regularize.snapped_us(F.col("us"), F.lit(1_800_000_000))).alias("at")).toPandas()["at"]
    want = pd.to_datetime(["2020-01-01 00:15", "2020-01-01 00:45", "2020-01-01 00:14"]).round("30min")
    assert list(got) == list(want)


def test_short_gaps_at_the_ends(spark):
    rows = [("s", i * 10, v) for i, v in enumerate([None, 1.0, None, 3.0, None, None])]
    grid = spark.createDataFrame(rows, "series_id string, slot_us long, value double")
    got = [r.value for r in regularize.interpolate_short(regularize.classify_gaps(grid)).orderBy("slot_us").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 3.0, 3.0]


def test_sanity_bounds_and_duplicates(spark):
    rows = spark.createDataFrame([("s", "2020-01-01", 20.0, 0), ("s", "2020-01-01", 1.0, 1), ("s", "2020-01-02", -1.0, 2)], "series_id string, d string, value double, pos long").withColumn("ts", F.to_timestamp("d"))
    assert regularize.deduplicate(rows).where("d = '2020-01-01'").first().value == 20.0
    assert regularize.sane(rows).where("is_bad").count() == 2


def test_empty_table(spark):
    rows = spark.createDataFrame([], "series_id string, ts timestamp, value double")
    grid, report = regularize.regularize(rows)
    assert grid.count() == 0 and report.count() == 0
