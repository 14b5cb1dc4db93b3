"""Scans: point series, several variables, rasters, catalogs, optional tables. All through Spark's readers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resolve_column(columns: list[str], wanted: str, aliases: Mapping[str, tuple[str, ...]] | None = None) -> str:
    """The column named wanted, or by one of its aliases, in any case; KeyError if there is none."""
    by_lower = {c.lower(): c for c in columns}
    for name in (wanted, *(aliases or {}).get(wanted, ())):
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    raise KeyError(f"no column {wanted!r} among {columns}")


def point_series(df: DataFrame, series: str, ts: str, value: str, order: str | None = None) -> DataFrame:
    """(series_id, ts, value[, pos]) from any table; ts becomes a timestamp, NaN a null."""
    v = F.col(resolve_column(df.columns, value)).cast("double")
    cols = [F.col(resolve_column(df.columns, series)).alias("series_id"), F.col(resolve_column(df.columns, ts)).cast("timestamp").alias("ts"), F.when(~F.isnan(v), v).alias("value")]
    if order:
        cols.append(F.col(resolve_column(df.columns, order)).alias("pos"))
    return df.select(*cols)


def multi_variable(df: DataFrame, series: str, ts: str, variables: list[str]) -> DataFrame:
    """(series_id, ts, one column for each variable); a variable that the table lacks is null."""
    have = {c.lower(): c for c in df.columns}
    cols = [F.col(have[v.lower()]).cast("double").alias(v) if v.lower() in have else F.lit(None).cast("double").alias(v) for v in variables]
    return df.select(F.col(series).alias("series_id"), F.col(ts).cast("timestamp").alias("ts"), *cols)


def long_form(wide: DataFrame, variables: list[str]) -> DataFrame:
    """(series_id, var, ts, value) of a multi-variable frame, without nulls."""
    pairs = ", ".join(f"'{v}', `{v}`" for v in variables)
    return wide.selectExpr("series_id", "ts", f"stack({len(variables)}, {pairs}) as (var, value)").where("value is not null")


def capabilities(long: DataFrame) -> DataFrame:
    """(series_id, available_variables, first_ts, last_ts, n, duplicates) of long-form samples."""
    return long.groupBy("series_id").agg(
        F.sort_array(F.collect_set("var")).alias("available_variables"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("var", "ts")).alias("duplicates")
    )


def raster_at_stations(raster: DataFrame, stations: DataFrame) -> DataFrame:
    """(series_id, ts, raster variables, wind_speed, wind_from, air_sea): the raster (ts, lat, lon, ...) at the cell nearest each station, axis by axis.

    Nearest cells come from the distinct axis values, so the raster itself is
    only read through an equi-join. Variables u10 and v10 give wind, t2m and
    sst the difference of temperatures, where present. Repeated times keep one row.
    """
    out = stations
    for axis in ("lat", "lon"):
        cells = raster.select(F.col(axis).alias("cell")).distinct()
        near = stations.select("series_id", F.col(axis).alias("at")).join(cells, how="cross").groupBy("series_id").agg(F.min_by("cell", F.struct(F.abs(F.col("cell") - F.col("at")), "cell")).alias(f"cell_{axis}"))
        out = out.join(near, "series_id")
    met = raster.join(out.select("series_id", F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon")), ["lat", "lon"]).drop("lat", "lon")
    rest = [c for c in met.columns if c not in ("series_id", "ts")]
    met = met.groupBy("series_id", "ts").agg(F.min(F.struct(*rest)).alias("r")).select("series_id", "ts", "r.*")
    if {"u10", "v10"} <= set(rest):
        from ..functions.scalars import wind_from, wind_speed

        met = met.withColumn("wind_speed", wind_speed(F.col("u10"), F.col("v10"))).withColumn("wind_from", wind_from(F.col("u10"), F.col("v10")))
    if {"t2m", "sst"} <= set(rest):
        met = met.withColumn("air_sea", F.col("t2m") - F.col("sst"))
    return met


def geofenced(files: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Files (path, lat, lon) inside a box, with series_id, the last _ part of the file's name."""
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.where(F.col("lat").between(*lat) & F.col("lon").between(*lon)).withColumn("series_id", F.element_at(F.split(name, "_"), -1))


def filtered_paths(spark: SparkSession, folder: str, pattern: str | None, schema: str, kind: str = "csv") -> DataFrame:
    """Rows of the files of a folder whose names match a glob; refuses to read a folder whole."""
    if not pattern or pattern in ("*", "**"):
        raise ValueError("give a pattern that selects files")
    return spark.read.format(kind).schema(schema).option("header", "true").option("pathGlobFilter", pattern).load(folder)


def coverage(samples: DataFrame) -> DataFrame:
    """(series_id, first_ts, last_ts, n, n_valid)."""
    return samples.groupBy("series_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.count("value").alias("n_valid"))
