"""Rolling statistics, differences, labels and calendar windows, in chunks with halos instead of whole-series tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Ordered, with_halo, with_micros

DAY_US = 86_400_000_000


def rolling_time(samples: DataFrame, span_us: int, aggregates: dict[str, Column], keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """samples with aggregates over the time frame (t - span, t]: the row at exactly t - span is out."""
    keys = keys or ["series_id"]
    rows = with_halo(with_micros(samples, ts), "us", max(span_us, DAY_US), back=span_us)
    frame = Window.partitionBy(*keys, "__chunk").orderBy("us").rangeBetween(-(span_us - 1), 0)
    for name, agg in aggregates.items():
        rows = rows.withColumn(name, agg.over(frame))
    return rows.where("__own").drop("__chunk", "__own", "us")


def rolling_sums(samples: DataFrame, span_us: int, columns: list[str], keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """samples with rows_in and sum_<column> over the time frame (t - span, t], for columns of exact numbers (integers, decimals).

    A sliding frame is added up anew for each row, so its cost grows with the
    rows in a frame. Here a frame is the difference of two running sums: the
    one at the row, and the one of the last row at or before t - span, found by
    sorting the rows together with their own times shifted back.
    """
    keys = keys or ["series_id"]
    rows = with_micros(samples, ts)
    upto = Window.partitionBy(*keys).orderBy("us")  # rows of one time count for each other
    rows = rows.withColumn("__sums", F.struct(F.count(F.lit(1)).over(upto).alias("rows_in"), *(F.sum(c).over(upto).alias(f"sum_{c}") for c in columns)))
    row = F.struct(*[c for c in rows.columns if c not in (*keys, "us")])
    ends = rows.select(*keys, "us", F.lit(False).alias("__ask"), F.col("__sums").alias("__end"), F.lit(None).cast(rows.select(row.alias("r")).schema["r"].dataType).alias("__row"))
    asks = rows.select(*keys, (F.col("us") - span_us).alias("us"), F.lit(True).alias("__ask"), F.lit(None).cast(rows.schema["__sums"].dataType).alias("__end"), row.alias("__row"))
    met = Ordered(ends.unionByName(asks), keys, tie=["__ask"]).last_valid(["__end"], F.col("__end").isNotNull(), "__out").done().where("__ask")
    met = met.select(*keys, "__row.*", F.col("__out.__end").alias("__before"))
    sums = {n: F.col(f"__sums.{n}") - F.coalesce(F.col(f"__before.{n}"), F.lit(0)) for n in ("rows_in", *(f"sum_{c}" for c in columns))}
    return met.withColumns(sums).drop("__sums", "__before")


def trailing_rows(indexed: DataFrame, rows: int, aggregates: dict[str, Column], keys: list[str] | None = None, idx: str = "idx", ahead: tuple[int, int] | None = None) -> DataFrame:
    """indexed with aggregates over its last `rows` rows, itself included; ahead=(a, b): over the rows a to b after it."""
    keys = keys or ["series_id"]
    lo, hi = (-(rows - 1), 0) if ahead is None else ahead
    out = with_halo(indexed, idx, max(4096, rows, abs(lo), abs(hi)), back=max(0, -lo), ahead=max(0, hi))
    frame = Window.partitionBy(*keys, "__chunk").orderBy(idx).rowsBetween(lo, hi)
    for name, agg in aggregates.items():
        out = out.withColumn(name, agg.over(frame))
    return out.where("__own").drop("__chunk", "__own")


def difference(samples: DataFrame, order: int = 1, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """samples with `diff`, the difference of the given order inside each key group (segment)."""
    keys = keys or ["series_id", "seg_id"]
    rows = Ordered(with_micros(samples, ts).withColumn("diff", F.col("value")), keys)
    for _ in range(order):
        rows = rows.previous("diff", "__p")
        rows = rows._with(rows.df.withColumn("diff", F.col("diff") - F.col("__p")).drop("__p"))
    return rows.done().drop("us")


def exceedance_features(indexed: DataFrame, window: int = 12, keys: list[str] | None = None) -> DataFrame:
    """indexed with level, trend (value minus that `window` rows before, else 0) and volatility (population deviation of the trailing window with over 5 valid values, else 0)."""
    stats = {"__sd": F.stddev_pop("value"), "__n": F.count("value"), "__first": F.first("value"), "__rows": F.count(F.lit(1))}
    out = trailing_rows(indexed, window + 1, {"__first": stats["__first"], "__rows": stats["__rows"]}, keys)
    out = trailing_rows(out, window, {"__sd": stats["__sd"], "__n": stats["__n"]}, keys)
    trend = F.when(F.col("__rows") == window + 1, F.coalesce(F.col("value") - F.col("__first"), F.lit(0.0))).otherwise(0.0)
    return out.withColumn("level", F.col("value")).withColumn("trend", trend).withColumn("volatility", F.when(F.col("__n") > 5, F.col("__sd")).otherwise(0.0)).drop("__sd", "__n", "__first", "__rows")


def exceedance_label(indexed: DataFrame, horizon: int, threshold: str = "threshold", keys: list[str] | None = None) -> DataFrame:
    """indexed with label: 1 if a value in the next `horizon` rows is above the threshold column, 0 if none, null without valid values."""
    out = trailing_rows(indexed, 1, {"__m": F.max("value")}, keys, ahead=(1, horizon))
    return out.withColumn("label", (F.col("__m") > F.col(threshold)).cast("int")).drop("__m")


def calendar_windows(samples: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """samples with window 1..n: parts of equal duration of each series, the last one closed at its end."""
    rows = with_micros(samples, ts)
    ends = rows.groupBy("series_id").agg(F.min("us").alias("__lo"), F.max("us").alias("__hi"))
    met = rows.join(ends, "series_id")
    part = F.floor((F.col("us") - F.col("__lo")) * F.lit(n) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1))).cast("int") + 1
    return met.withColumn("window", F.least(part, F.lit(n))).drop("us", "__lo", "__hi")
