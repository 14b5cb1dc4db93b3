import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.operators import forecast, joins, stats, windows
from driftline.operators.ordered import Ordered, with_micros

T0 = dt.datetime(2020, 1, 1)
HOUR = 3_600_000_000


def series(spark, values, name="s", step=60):
    return spark.createDataFrame([(name, T0 + dt.timedelta(minutes=step * i), v) for i, v in enumerate(values)], "series_id string, ts timestamp, value double")


def indexed(spark, values):
    return Ordered(with_micros(series(spark, values)), ["series_id"]).index("idx").done()


def test_rolling_frames_agree(spark):
    rows = series(spark, [float(i * 7 % 11) for i in range(200)], step=37).withColumn("c", F.col("value").cast("long"))
    a = windows.rolling_time(rows, 6 * HOUR, {"n": F.count("c"), "s": F.sum("c")}).select("ts", "n", "s")
    b = windows.rolling_sums(rows, 6 * HOUR, ["c"]).select("ts", F.col("rows_in").alias("n"), F.col("sum_c").alias("s"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_left_end_is_open(spark):
    got = windows.rolling_time(series(spark, [1.0] * 8), 3 * HOUR, {"n": F.count("value")}).orderBy("ts").collect()
    assert [r.n for r in got] == [1, 2, 3, 3, 3, 3, 3, 3]


def test_persistence_on_a_ramp(spark):
    rows = indexed(spark, [0.5 * i for i in range(100)])
    bt = forecast.persistence(rows, [1, 4], 3, 10, 2)
    assert {(r.horizon_samples, r.error) for r in bt.collect()} == {(1, 0.5), (4, 2.0)}
    s = forecast.summarize(bt, 1.0)
    assert {r.skill for r in forecast.skill(s, s).collect()} == {0.0}


def test_stale_values_are_not_persisted(spark):
    rows = indexed(spark, [1.0, None, None, None, 2.0, 3.0])
    got = {(r.origin_idx, r.predicted) for r in forecast.persistence(rows, [1], 1, 0, 2).collect()}
    assert got == {(4, 2.0)}


def test_lag_sign(spark):
    import math

    rows = indexed(spark, [math.sin(i / 5) + math.cos(i * i) for i in range(80)])
    later = rows.select("series_id", (F.col("idx") + 6).alias("idx"), F.col("value").alias("y"))
    both = rows.withColumnRenamed("value", "x").join(later, ["series_id", "idx"])
    assert stats.best_lag(stats.cross_correlation(both, "x", "y", 10), ["series_id"]).first().lag == 6


def test_asof_takes_the_later_of_two_as_near(spark):
    left = series(spark, [None]).withColumn("ts", F.expr("ts + interval 1 hour")).select("series_id", "ts")
    right = series(spark, [1.0, None, 3.0])
    assert joins.asof_nearest(left, right, ["series_id"], "value", HOUR).first().value == 3.0
    assert joins.asof_nearest(left, right, ["series_id"], "value", HOUR - 1).first().value is None
    assert joins.asof_interpolate(left, right, ["series_id"], "value").first().value == pytest.approx(2.0)


def test_features_and_labels(spark):
    rows = indexed(spark, [float(i) for i in range(20)]).withColumn("threshold", F.lit(17.5))
    got = {r.idx: r for r in windows.exceedance_label(windows.exceedance_features(rows, 6), 2).collect()}
    assert (got[3].trend, got[3].volatility) == (0.0, 0.0) and got[10].trend == 6.0
    assert [got[i].label for i in (15, 16, 18, 19)] == [0, 1, 1, None]


def test_differences_stay_in_segments(spark):
    rows = series(spark, [1.0, 4.0, 9.0, 1.0, 2.0]).withColumn("seg_id", F.when(F.col("value") < 3, 1).otherwise(0))
    got = [r["diff"] for r in windows.difference(rows).orderBy("ts").collect()]
    assert got == [None, None, 5.0, 0.0, 1.0]


def test_harmonics_are_removed(spark):
    import math

    rows = series(spark, [3 + math.cos(2 * math.pi * i / 12) if i % 7 else None for i in range(200)])
    got = stats.harmonic_regression(rows, [(12.0, 1)]).agg(F.max(F.abs("residual")).alias("r"), F.count("fitted").alias("n")).first()
    assert got.r < 1e-9 and got.n == 200
