"""Joins along time: nearest within a tolerance, interpolating, lagged, and unordered pairs of series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, with_micros


def _bracketed(left: DataFrame, right: DataFrame, keys: list[str], value: str, chunk_us: int | None) -> DataFrame:
    """left's rows with (us, value) of right's last row at or before and first row at or after them, as before_ and after_."""
    a = with_micros(left).withColumn("__left", F.lit(True)).withColumn("__row", F.struct(*[c for c in left.columns if c not in keys]))
    b = with_micros(right).where(F.col(value).isNotNull())
    both = a.select(*keys, "us", "__left", "__row", F.lit(None).cast("double").alias("__w")).unionByName(
        b.select(*keys, "us", F.lit(False).alias("__left"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).cast("double").alias("__w"))
    )
    rows = Ordered(both, keys, tie=["__left"], chunk_us=chunk_us)  # a right row at the very time of a left row comes first, and counts on both sides
    rows = rows.last_valid(["us", "__w"], F.col("__w").isNotNull(), "before_").next_valid(["us", "__w"], F.col("__w").isNotNull(), "after_")
    out = rows.done().where("__left")
    same = F.col("before_.us") == F.col("us")
    return out.withColumn("after_", F.when(same, F.col("before_")).otherwise(F.col("after_"))).select(*keys, "us", "__row.*", "before_", "after_")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance_us: int, name: str | None = None, chunk_us: int | None = None) -> DataFrame:
    """left with right's value nearest in time, at most tolerance_us away, else null; of two as near the later. chunk_us: see Ordered."""
    met = _bracketed(left, right, keys, value, chunk_us)
    back, ahead = F.col("us") - F.col("before_.us"), F.col("after_.us") - F.col("us")
    pick = F.when(ahead.isNotNull() & (back.isNull() | (ahead <= back)), F.when(ahead <= tolerance_us, F.col("after_.__w"))).when(back <= tolerance_us, F.col("before_.__w"))
    return met.withColumn(name or value, pick).drop("us", "before_", "after_")


def asof_interpolate(left: DataFrame, right: DataFrame, keys: list[str], value: str, name: str | None = None, chunk_us: int | None = None) -> DataFrame:
    """left with right's value interpolated linearly in time; after right's end its last value, before its start null. chunk_us: see Ordered."""
    met = _bracketed(left, right, keys, value, chunk_us)
    x0, x1 = F.col("before_.us"), F.col("after_.us")
    y0, y1 = F.col("before_.__w"), F.col("after_.__w")
    line = F.when(x0 == x1, y0).otherwise(y0 + (y1 - y0) * (F.col("us") - x0) / (x1 - x0))
    return met.withColumn(name or value, F.when(x0.isNotNull(), F.coalesce(line, y0))).drop("us", "before_", "after_")


def series_pairs(samples: DataFrame, at: str = "ts", value: str = "value") -> DataFrame:
    """(a, b, at, x, y): values of each two series at a common time, a < b. Joined on time, so pairs of series without common times never meet."""
    left = samples.select(F.col(at).alias("at"), F.col("series_id").alias("a"), F.col(value).alias("x"))
    right = samples.select(F.col(at).alias("__at"), F.col("series_id").alias("b"), F.col(value).alias("y"))
    return left.join(right, (F.col("at") == F.col("__at")) & (F.col("a") < F.col("b"))).drop("__at")


def binned_with_raster(samples: DataFrame, raster: DataFrame, hours: int = 3) -> DataFrame:
    """(series_id, ts, value, n, raster columns): means of samples in bins of so many hours, met with the raster's rows (series_id, ts, ...) of those times."""
    us = hours * 3_600_000_000
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / us) * us
    bins = samples.groupBy("series_id", F.timestamp_micros(start.cast("long")).alias("ts")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return bins.join(raster, ["series_id", "ts"])
