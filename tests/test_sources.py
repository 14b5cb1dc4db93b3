import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from driftline import queries
from driftline.plans import stages
from driftline.sources import sinks, tables
from driftline.streaming import live


def netcdf(path, times, values, fill=-999.0):
    """A classic NetCDF file with a TIME dimension and a VHM0 variable, written by hand."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    n = len(times)
    attr = struct.pack(">ii", 0x0C, 1) + name("_FillValue") + struct.pack(">ii", 6, 1) + struct.pack(">d", fill)
    none = struct.pack(">ii", 0, 0)
    dims = struct.pack(">ii", 0x0A, 1) + name("TIME") + struct.pack(">i", n)
    glob = struct.pack(">ii", 0x0C, 1) + name("title") + struct.pack(">ii", 2, 4) + b"test"

    def variables(a, b):
        out = struct.pack(">ii", 0x0B, 2)
        for key, extra, at in (("TIME", none, a), ("VHM0", attr, b)):
            out += name(key) + struct.pack(">ii", 1, 0) + extra + struct.pack(">iii", 6, 8 * n, at)
        return out

    head = b"CDF\x01" + struct.pack(">i", 0) + dims + glob
    size = len(head) + len(variables(0, 0))
    with open(path, "wb") as f:
        f.write(head + variables(size, size + 8 * n) + struct.pack(f">{n}d", *times) + struct.pack(f">{n}d", *values))


def test_netcdf_source(spark, tmp_path):
    from driftline.sources.netcdf3 import NetCdf3

    netcdf(tmp_path / "one.nc", [0.0, 1.0, 2.0], [1.5, -999.0, 2.5])
    spark.dataSource.register(NetCdf3)
    rows = spark.read.format("netcdf3").option("paths", str(tmp_path / "one.nc")).option("variables", "vhm0").load().orderBy("pos").collect()
    assert [(r.time, r.value) for r in rows] == [(0.0, 1.5), (1.0, None), (2.0, 2.5)]
    head = spark.read.format("netcdf3").option("paths", str(tmp_path / "one.nc")).option("metadata", "true").load().collect()
    assert {(r.kind, r.name) for r in head} >= {("attribute", "title"), ("dimension", "TIME"), ("variable", "VHM0")}


def test_netcdf_through_spark(spark, tmp_path):
    """Packed values and times: scale, offset, units; read by Spark's own reader."""
    from driftline.sources.netcdf3 import Header, read_netcdf

    netcdf(tmp_path / "one.nc", [0.0, 0.5, 1.0], [15.0, -999.0, 25.0])
    head = Header((tmp_path / "one.nc").read_bytes())
    head.vars["VHM0"]["attrs"] |= {"scale_factor": [0.1], "add_offset": [2.0]}
    assert [round(v, 6) if v == v else None for v in head.values("VHM0")] == [3.5, None, 4.5]
    head.vars["TIME"]["attrs"]["units"] = "days since 1950-01-01T00:00:00Z"
    assert head.times("TIME")[1] == (dt.datetime(1950, 1, 1, 12) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6
    rows = read_netcdf(spark, str(tmp_path), ["vhm0"]).orderBy("pos").collect()
    assert [(r.var, r.ts, r.value) for r in rows] == [("VHM0", None, 15.0), ("VHM0", None, None), ("VHM0", None, 25.0)]


def test_names_and_scans(spark):
    assert tables.resolve_column(["Latitude", "x"], "latitude") == "Latitude"
    assert tables.resolve_column(["valid_time"], "time", {"time": ("valid_time",)}) == "valid_time"
    with pytest.raises(KeyError):
        tables.resolve_column(["a"], "b")
    with pytest.raises(ValueError):
        tables.filtered_paths(spark, "/tmp", "*", "a int")
    rows = spark.createDataFrame([("s", dt.datetime(2020, 1, 1), float("nan"))], "id string, TIME timestamp, VHM0 double")
    assert tables.point_series(rows, "id", "time", "vhm0").first().value is None


def test_raster_nearest_cell(spark):
    t = dt.datetime(2020, 1, 1)
    raster = spark.createDataFrame([(t, la, lo, u, v, 280.0, 279.0) for la, lo, u, v in ((51.0, 2.0, 0.0, -5.0), (51.0, 2.25, -5.0, 0.0), (51.25, 2.0, 0.0, 5.0), (51.25, 2.25, 5.0, 0.0))], "ts timestamp, lat double, lon double, u10 double, v10 double, t2m double, sst double")
    stations = spark.createDataFrame([("n", 51.02, 2.01), ("e", 51.02, 2.2), ("s", 51.2, 2.01), ("w", 51.2, 2.2)], "series_id string, lat double, lon double")
    got = {r.series_id: (round(r.wind_from) % 360, r.wind_speed, r.air_sea) for r in tables.raster_at_stations(raster, stations).collect()}
    assert got == {"n": (0, 5.0, 1.0), "e": (90, 5.0, 1.0), "s": (180, 5.0, 1.0), "w": (270, 5.0, 1.0)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "series_id string, x int")
    path = sinks.write_stage(rows, str(tmp_path), "one", by=["series_id"])
    assert sinks.existing_partitions(spark, path, "series_id") == ["a", "b"] and sinks.existing_partitions(spark, f"{path}x", "series_id") == []
    sinks.write_summary(rows, str(tmp_path), "one")
    for status in ("ok", "failed"):
        sinks.log_run(spark, str(tmp_path / "log"), "one", status)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    sinks.write_report(rows.withColumn("report", F.col("series_id")), str(tmp_path / "report"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "report")).collect()) == ["a", "b"]


def test_stages(spark, data, tmp_path):
    names = [s.name for s in stages.ordered()]
    assert names.index("clean") < names.index("dependence") < names.index("extremes")
    with pytest.raises(ValueError):
        stages.ordered([stages.Stage("a", "q", ("b",)), stages.Stage("b", "q", ("a",))])
    assert all(s.query in queries.QUERIES for s in stages.STAGES)

    def fails(spark, d):
        raise RuntimeError("no")

    log = {r.stage: r.status for r in stages.run(spark, data, {**queries.QUERIES, "persistence_summary": fails}, str(tmp_path), ["clean", "persistence", "arma"]).collect()}
    assert log == {"clean": "ok", "persistence": "failed", "arma": "skipped"}
    assert stages.provenance(spark).first().package_versions["spark"]


def test_last_values_on_a_stream(spark, tmp_path):
    rows = [("a", dt.datetime(2020, 1, 1, h), float(h)) for h in range(5)] + [("a", dt.datetime(2020, 1, 2), None), ("b", dt.datetime(2020, 1, 1), 9.0)]
    spark.createDataFrame(rows, "series_id string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.read_samples(spark, str(tmp_path / "in"), "series_id string, ts timestamp, value double")
    got = {r.series_id: r.value for r in live.drained(live.last_values(stream), "last", "update").collect()}
    assert got == {"a": 4.0, "b": 9.0}
    once = live.drained(live.deduplicated(stream), "once")
    assert once.count() == 7


def test_sql_functions(spark):
    from driftline.functions import scalars

    scalars.register(spark)
    r = spark.sql("select haversine_km(51, 2, 52, 2) as km, circ_diff(350, 10) as d, snap_us(2700000000, 1800000000) as s, gpd_return_level(1, 0.5, 0, 10, 10) as x").first()
    assert r.km == pytest.approx(111.19, abs=0.01) and r.d == 20 and r.s == 3_600_000_000 and r.x == pytest.approx(1 + 0.5 * 4.60517, abs=1e-4)
    z = spark.range(1).select(scalars.normal_two_sided(F.lit(1.959963985)).alias("p")).first().p
    assert z == pytest.approx(0.05, abs=1e-6)
