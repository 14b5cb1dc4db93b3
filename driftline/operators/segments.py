"""Contiguous stretches: runs of valid grid slots, runs without a time gap, and what depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Ordered, with_micros


def label_runs(grid: DataFrame, ts: str = "ts") -> DataFrame:
    """grid's valid rows with seg_id, the number of breaks before them in the series; a null value ends a run."""
    rows = Ordered(with_micros(grid, ts), ["series_id"])
    rows = rows.running_sum(F.col("value").isNull().cast("int"), "seg_id").done()
    return rows.where("value is not null").drop("us")


def summarize(labelled: DataFrame, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """(series_id, seg_id, n, start, end) of labelled rows."""
    return labelled.groupBy(*(keys or ["series_id", "seg_id"])).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))


def longest_segment(grid: DataFrame, ts: str = "ts") -> DataFrame:
    """(series_id, n_segments, segment_length, total_valid, pct_of_valid, start, end); of equal lengths the first."""
    runs = summarize(label_runs(grid, ts), ts=ts)
    best = runs.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("n").alias("total_valid"), F.max_by(F.struct("n", "start", "end"), F.struct(F.col("n"), (-F.unix_micros(F.col("start").cast("timestamp"))).alias("m"))).alias("b")
    )
    return best.select("series_id", "n_segments", F.col("b.n").alias("segment_length"), "total_valid", F.round(100 * F.col("b.n") / F.col("total_valid"), 1).alias("pct_of_valid"), F.col("b.start").alias("start"), F.col("b.end").alias("end"))


def top_segments(grid: DataFrame, min_length: int = 1, k: int = 50, ts: str = "ts") -> DataFrame:
    """The k longest runs of each series with at least min_length rows, with rank from 1."""
    runs = summarize(label_runs(grid, ts), ts=ts).where(F.col("n") >= min_length)
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("n"), "start"))).where(F.col("rank") <= k)


def segments_by_gap(samples: DataFrame, gap_us: int | None = None, keys: list[str] | None = None, multiplier: float = 1.5, ts: str = "ts") -> DataFrame:
    """samples with seg_id: a step longer than gap_us (or than multiplier times the row's dt_us) starts a new one, for all rows of its time."""
    keys = keys or ["series_id"]
    rows = Ordered(with_micros(samples, ts), keys).previous("us", "before")
    most = F.lit(gap_us) if gap_us is not None else F.col("dt_us") * F.lit(multiplier)
    return rows.running_sum(F.when(F.col("us") - F.col("before") > most, 1).otherwise(0), "seg_id", peers=True).done().drop("us", "before")


def with_era(samples: DataFrame, eras: DataFrame, ts: str = "ts") -> DataFrame:
    """samples with era_id and dt_us of the era (series_id, era_id, start, end, dt_us) that holds them; the first of several. Rows in no era go, rows of one time all stay."""
    lo, hi = (F.unix_micros(F.col(c).cast("timestamp")).alias(name) for c, name in (("start", "lo"), ("end", "hi")))
    e = eras.groupBy(F.col("series_id").alias("__s")).agg(F.collect_list(F.struct("era_id", "dt_us", lo, hi)).alias("__eras"))
    met = with_micros(samples, ts).join(e, F.col("series_id") == F.col("__s"))
    met = met.withColumn("__e", F.array_min(F.filter("__eras", lambda x: F.col("us").between(x["lo"], x["hi"])))).where("__e is not null")
    return met.select(*samples.columns, "__e.era_id", "__e.dt_us")


def segments_by_gap_in_eras(samples: DataFrame, eras: DataFrame, multiplier: float = 1.5, ts: str = "ts") -> DataFrame:
    """samples in eras with seg_id counted inside each era, by that era's own step."""
    return segments_by_gap(with_era(samples, eras, ts), None, ["series_id", "era_id"], multiplier, ts)


def interval_at(starts: DataFrame, eras: DataFrame, fallback_us: int = 1_800_000_000) -> DataFrame:
    """starts (series_id, ts) with dt_us of their era; fallback_us for a series without eras; an error for a start outside all eras of its series."""
    known = eras.select("series_id").distinct().withColumn("__has", F.lit(True))
    base = with_micros(starts)
    met = with_era(starts, eras).select("series_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "dt_us").distinct()
    out = base.join(met, ["series_id", "us"], "left").join(known, "series_id", "left")
    lost = F.raise_error(F.concat(F.lit("start outside every era of series "), F.col("series_id").cast("string")))
    return out.withColumn("dt_us", F.when(F.col("dt_us").isNotNull(), F.col("dt_us")).when(F.col("__has").isNull(), F.lit(fallback_us)).otherwise(lost.cast("long"))).drop("us", "__has")


def dominant_interval(segments: DataFrame) -> DataFrame:
    """The segments (series_id, dt_us, n, ...) whose step covers most samples of their series; the shorter step on ties."""
    cover = segments.groupBy("series_id", "dt_us").agg(F.sum("n").alias("n"))
    best = cover.groupBy("series_id").agg(F.max(F.struct("n", (-F.col("dt_us")).alias("m"))).alias("b")).select("series_id", (-F.col("b.m")).alias("dt_us"))
    return segments.join(best, ["series_id", "dt_us"], "left_semi")


def block_length(counts: DataFrame, known: DataFrame) -> DataFrame:
    """counts (series_id, n) with block_length and its source: from known (series_id, block_length, hit_ceiling) or max(1, floor(sqrt(n)))."""
    out = counts.join(known.withColumnRenamed("block_length", "__b"), "series_id", "left")
    return out.select("series_id", "n", F.coalesce("__b", F.greatest(F.lit(1), F.floor(F.sqrt("n")))).cast("long").alias("block_length"), F.when(F.col("__b").isNotNull(), "dependence").otherwise("sqrt_n").alias("source"), F.coalesce("hit_ceiling", F.lit(False)).alias("hit_ceiling"))
