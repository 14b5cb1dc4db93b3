import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftline.operators import segments

T0 = dt.datetime(2020, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def table(spark, rows):
    return spark.createDataFrame(rows, "series_id string, ts timestamp, value double")


def test_longest_first_wins_ties(spark):
    values = [1.0, 2.0, None, 3.0, 4.0, None, None, 5.0]
    got = segments.longest_segment(table(spark, [("s", at(i), v) for i, v in enumerate(values)])).first()
    assert (got.n_segments, got.segment_length, got.total_valid, got.pct_of_valid, got.start) == (3, 2, 5, 40.0, at(0))


def test_no_valid_value(spark):
    assert segments.longest_segment(table(spark, [("s", at(0), None)])).count() == 0


def test_top_segments(spark):
    values = [1.0, None, 1.0, 1.0, None, 1.0, 1.0, 1.0]
    got = segments.top_segments(table(spark, [("s", at(i), v) for i, v in enumerate(values)]), min_length=2, k=5).orderBy("rank").collect()
    assert [r.n for r in got] == [3, 2]


def eras(spark):
    rows = [("s", 1, at(0), at(150), 15 * 60_000_000), ("s", 2, at(170), at(400), 30 * 60_000_000)]
    return spark.createDataFrame(rows, "series_id string, era_id long, start timestamp, end timestamp, dt_us long")


def test_gap_inside_an_era_and_seam(spark):
    first = [0, 15, 30, 70, 85, 100, 115, 130, 150]  # 40 minutes without a row after 30
    second = [170, 200, 230, 260]
    rows = table(spark, [("s", at(m), 1.0) for m in first + second])
    got = segments.segments_by_gap_in_eras(rows, eras(spark)).groupBy("era_id", "seg_id").count().orderBy("era_id", "seg_id").collect()
    assert [(r.era_id, r.seg_id, r["count"]) for r in got] == [(1, 0, 3), (1, 1, 6), (2, 0, 4)]


def test_exact_gap_does_not_break(spark):
    rows = table(spark, [("s", at(m), 1.0) for m in (0, 30, 60, 91)])
    got = segments.segments_by_gap(rows, gap_us=30 * 60_000_000).agg(F.max("seg_id").alias("m")).first()
    assert got.m == 1


def test_interval_lookup(spark):
    starts = table(spark, [("s", at(15), None), ("s", at(200), None), ("other", at(0), None)]).select("series_id", "ts")
    got = {(r.series_id, r.ts): r.dt_us for r in segments.interval_at(starts, eras(spark)).collect()}
    assert got == {("s", at(15)): 900_000_000, ("s", at(200)): 1_800_000_000, ("other", at(0)): 1_800_000_000}
    with pytest.raises(PySparkException):
        segments.interval_at(table(spark, [("s", at(5000), None)]).select("series_id", "ts"), eras(spark)).collect()


def test_chunks_agree_with_plain_windows(spark):
    """The chunked primitives give what windows over whole series give."""
    from pyspark.sql import Window

    from driftline.operators.ordered import Ordered, with_halo

    rows = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 5000).alias("us"), F.when(F.col("id") % 4 != 0, F.col("id") * 1.0).alias("v")).dropDuplicates(["k", "us"])
    w = Window.partitionBy("k").orderBy("us")
    valid = F.col("v").isNotNull()
    got = Ordered(rows, ["k"], chunk_us=300).previous("us", "p").following("us", "n").index("i").running_sum(valid.cast("int"), "s").last_valid(["us", "v"], valid, "lv").next_valid(["us", "v"], valid, "nv").done()
    want = rows.select("*", F.lag("us").over(w).alias("p"), F.lead("us").over(w).alias("n"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.sum(valid.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
                       F.last(F.when(valid, F.struct("us", "v")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("lv"), F.first(F.when(valid, F.struct("us", "v")), True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("nv"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    halo = with_halo(rows, "us", 400, back=350).withColumn("m", F.max("v").over(Window.partitionBy("k", "__chunk").orderBy("us").rangeBetween(-350, 0))).where("__own")
    plain = rows.withColumn("m", F.max("v").over(w.rangeBetween(-350, 0)))
    assert sorted(map(str, halo.select("k", "us", "m").collect())) == sorted(map(str, plain.select("k", "us", "m").collect()))


def test_era_of_rows_with_one_time(spark):
    """All rows of a time get the first era that holds it, and a start that comes twice is looked up twice."""
    several = eras(spark).unionByName(spark.createDataFrame([("s", 3, at(100), at(120), 60_000_000)], eras(spark).schema))
    rows = table(spark, [("s", at(110), 1.0), ("s", at(110), 2.0), ("s", at(180), 3.0), ("s", at(160), 4.0)])
    got = sorted(tuple(r) for r in segments.with_era(rows, several).select("value", "era_id", "dt_us").collect())
    assert got == [(1.0, 1, 900_000_000), (2.0, 1, 900_000_000), (3.0, 2, 1_800_000_000)]
    twice = segments.interval_at(rows.where("value < 3").select("series_id", "ts"), several).collect()
    assert [r.dt_us for r in twice] == [900_000_000, 900_000_000]
