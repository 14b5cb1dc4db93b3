"""Rows that share a time all count, as in SQL."""

import datetime as dt

import duckdb

from driftline import queries

T0 = dt.datetime(2024, 1, 1)


def minutes(m, day=1):
    return T0 + dt.timedelta(days=day - 1, minutes=m)


def both(spark, folder, name, rows):
    """(a query's rows, its SQL's rows) on events (event_type, ts, value), in the order of their ids."""
    con = duckdb.connect()
    con.sql("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.executemany("insert into events values (?, ?, ?, ?, ?, ?)", [(k, ts, 1, kind, value, '{"k": 1}') for k, (kind, ts, value) in enumerate(rows)])
    con.sql(f"copy events to '{folder}/events.parquet'")
    df, want = queries.QUERIES[name](spark, str(folder)), con.sql(queries.ORACLE_SQL[name])
    columns = ", ".join(want.columns)
    return sorted(map(tuple, df.selectExpr(*want.columns).collect())), sorted(want.project(columns).fetchall())


#: Three rows of one time in the first era, and two times in the second.
TIED = [("view", minutes(5), 1.0), ("view", minutes(5), 2.0), ("view", minutes(5), 4.0), ("view", minutes(0, 20), 8.0), ("view", minutes(30, 20), 16.0)]


def test_dominant_interval(spark, tmp_path):
    got, want = both(spark, tmp_path, "dominant_interval", TIED)
    assert got == want == [("view", 1_200_000_000, 3)]


def test_events_in_eras(spark, tmp_path):
    got, want = both(spark, tmp_path, "events_in_eras", TIED)
    assert got == want == [("view", 1, 3, 7.0 / 3), ("view", 2, 2, 12.0)]


def test_events_in_eras_without_values(spark, tmp_path):
    """The mean is over all rows, also those without a value; null where no row has one."""
    got, want = both(spark, tmp_path, "events_in_eras", [*TIED, ("view", minutes(5), None), ("view", minutes(9, 20), None), ("click", minutes(5), None)])
    assert got == want == [("click", 1, 1, None), ("view", 1, 4, 7.0 / 4), ("view", 2, 3, 8.0)]


def test_gap_sessions_in_eras(spark, tmp_path):
    after_gaps = [("view", minutes(m), float(k)) for m in (0, 60, 120, 180) for k in range(4)]
    rows = [*after_gaps, *TIED[3:]]
    got, want = both(spark, tmp_path, "gap_sessions_in_eras", rows)
    assert got == want == [("view", 1, 4, 4), ("view", 2, 1, 2)]
    spark.conf.set("driftline.chunk_us", str(90 * 60_000_000))  # rows of one time may come in another order after a chunked step
    try:
        assert sorted(map(tuple, queries.QUERIES["gap_sessions_in_eras"](spark, str(tmp_path)).select("series_id", "era_id", "segments", "longest").collect())) == want
    finally:
        spark.conf.unset("driftline.chunk_us")


def test_label_distance(spark, tmp_path):
    """A purchase of a view's time counts if its id is larger, as in the order of the file."""
    week = 7 * 1440
    kinds = ["view", "purchase", "view", "view", "purchase", "view", "click"]
    rows = [(kind, minutes(m), 1.0) for m in (0, 10, week, 3 * week) for kind in kinds]
    got, want = both(spark, tmp_path, "label_distance", rows)
    assert got == want
    assert [w for _, w in got[:4]] == [0, 0, 0, 600_000_000] and got[-1][1] is None
