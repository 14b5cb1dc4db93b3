"""From raw samples to a regular grid: eras of one sampling rate, snapping, gaps, short-gap interpolation, reports.

Samples have series_id, ts, value and optionally pos (file order). A missing
value is null. Eras have series_id, era_id, first_us, last_us and freq_us.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized
from .ordered import Ordered, first_in_order, with_micros

# Shortest run of steps that counts as an era, longest gap that is filled, upper bound of sane heights.
MIN_ERA_SAMPLES = 500
SHORT_GAP_LIMIT = 3
MAX_REASONABLE = 15.0
MINUTE_US = 60_000_000


def deduplicate(samples: DataFrame) -> DataFrame:
    """One row for each (series_id, ts): the first in file order."""
    return first_in_order(samples, ["series_id", "ts"], ["pos"] if "pos" in samples.columns else ["value"])


def modal_interval(samples: DataFrame) -> DataFrame:
    """(series_id, interval_us, n): the commonest step of each series, the shortest on ties."""
    steps = Ordered(with_micros(samples).select("series_id", "us"), ["series_id"]).previous("us", "before").done()
    counts = steps.where("before is not null").groupBy("series_id", (F.col("us") - F.col("before")).alias("interval_us")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("series_id").agg(F.max(F.struct("n", (-F.col("interval_us")).alias("m"))).alias("b"))
    return best.select("series_id", (-F.col("b.m")).alias("interval_us"), F.col("b.n").alias("n"))


def interval_runs(samples: DataFrame) -> DataFrame:
    """Runs of equal steps, rounded to minutes: (series_id, run_id, minutes, n, first_idx, last_idx), indexes of steps."""
    rows = Ordered(with_micros(samples).select("series_id", "us"), ["series_id"]).index("idx").previous("us", "before").done()
    steps = rows.where("before is not null").select("series_id", "us", (F.col("idx") - 1).alias("step"), F.rint((F.col("us") - F.col("before")) / MINUTE_US).cast("long").alias("minutes"))
    runs = Ordered(steps, ["series_id"]).previous("minutes", "prior")
    runs = runs.running_sum(F.when(F.col("prior").isNull() | (F.col("prior") != F.col("minutes")), 1).otherwise(0), "run_id").done()
    return runs.groupBy("series_id", "run_id", "minutes").agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("first_idx"), F.max("step").alias("last_idx"))


def detect_eras(samples: DataFrame, min_samples: int = MIN_ERA_SAMPLES) -> DataFrame:
    """(series_id, era_id, from_idx, to_idx, freq_hours): periods of one sampling rate, as sample indexes, to_idx exclusive.

    A run of equal steps counts from min_samples steps on; counted runs of one
    rate merge across what lies between; samples between the last counted step
    of one rate and the first of another belong to the era that follows. Without a
    counted run there is one era at the commonest step.
    """
    runs = interval_runs(samples)
    by = Window.partitionBy("series_id").orderBy("first_idx")
    counted = runs.where(F.col("n") >= min_samples).withColumn("new", F.coalesce((F.col("minutes") != F.lag("minutes").over(by)).cast("int"), F.lit(1)))
    merged = counted.withColumn("era_id", F.sum("new").over(by)).groupBy("series_id", "era_id").agg(F.first("minutes").alias("minutes"), F.max("last_idx").alias("last_step"))
    ends = samples.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_samples"))
    order = Window.partitionBy("series_id").orderBy("era_id")
    eras = merged.join(ends, "series_id").withColumn("to_idx", F.when(F.lead("era_id").over(order).isNull(), F.col("n_samples")).otherwise(F.col("last_step") + 2))
    eras = eras.withColumn("from_idx", F.coalesce(F.lag("to_idx").over(order), F.lit(0)))
    some = eras.select("series_id", "era_id", "from_idx", "to_idx", (F.col("minutes") / 60.0).alias("freq_hours"))
    counts = runs.groupBy("series_id", "minutes").agg(F.sum("n").alias("n"))
    common = counts.groupBy("series_id").agg(F.max(F.struct("n", (-F.col("minutes")).alias("m"))).alias("b"))
    rest = ends.join(merged.select("series_id").distinct(), "series_id", "left_anti").join(common, "series_id", "left")
    one = rest.select("series_id", F.lit(1).cast("long").alias("era_id"), F.lit(0).cast("long").alias("from_idx"), F.col("n_samples").alias("to_idx"), (-F.col("b.m") / 60.0).alias("freq_hours"))
    return some.unionByName(one)


def snapped_us(us, freq):
    """The nearest multiple of freq; a tie goes to the even multiple."""
    q = F.floor(us / freq).cast("long")
    r = us - q * freq
    up = (2 * r > freq) | ((2 * r == freq) & (q % 2 == 1))
    return (q + up.cast("long")) * freq


def snap(samples: DataFrame) -> DataFrame:
    """samples with freq_us, each moved to its grid slot `slot_us`; of several in a slot the first stays and `collisions` has the others' count."""
    keys = [c for c in ("series_id", "era_id") if c in samples.columns]
    at = samples.withColumn("slot_us", snapped_us(F.col("us"), F.col("freq_us")))
    return at.groupBy(*keys, "freq_us", "slot_us").agg(F.min_by("value", "us").alias("value"), (F.count(F.lit(1)) - 1).alias("collisions"))


def dense_grid(slots: DataFrame) -> DataFrame:
    """Every slot from each (series, era)'s first to its last, empty ones with a null value."""
    keys = [c for c in ("series_id", "era_id") if c in slots.columns]
    ends = slots.groupBy(*keys, "freq_us").agg(F.min("slot_us").alias("lo"), F.max("slot_us").alias("hi"))
    # two steps of sequence(): no row holds more than the slots of one block
    block = F.col("freq_us") * 4096
    blocks = ends.withColumn("block", F.explode(F.sequence("lo", "hi", block)))
    full = blocks.withColumn("slot_us", F.explode(F.sequence(F.col("block"), F.least(F.col("block") + block - F.col("freq_us"), F.col("hi")), F.col("freq_us"))))
    return full.select(*keys, "freq_us", "slot_us").join(slots.drop("freq_us"), [*keys, "slot_us"], "left")


def classify_gaps(grid: DataFrame) -> DataFrame:
    """grid with idx, gap_len (null slots in the run that a slot is in, 0 for valid ones)."""
    keys = [c for c in ("series_id", "era_id") if c in grid.columns]
    rows = Ordered(grid.withColumn("us", F.col("slot_us")).withColumn("valid", F.col("value").isNotNull()), keys).index("idx")
    rows = rows.last_valid(["idx", "value"], F.col("valid"), "left_").next_valid(["idx", "value"], F.col("valid"), "right_").done()
    ends = rows.groupBy(*keys).agg(F.max("idx").alias("last_idx"))
    rows = rows.join(ends, keys)
    length = F.coalesce(F.col("right_.idx") - 1, F.col("last_idx")) - F.coalesce(F.col("left_.idx") + 1, F.lit(0)) + 1
    return rows.withColumn("gap_len", F.when(F.col("valid"), 0).otherwise(length).cast("long")).drop("us", "last_idx")


def interpolate_short(classified: DataFrame, limit: int = SHORT_GAP_LIMIT) -> DataFrame:
    """value: short gaps filled linearly by position; a short gap at the end repeats the last value, one at the start stays null.

    is_interpolated marks each slot of a short gap, filled or not.
    """
    short = ~F.col("valid") & (F.col("gap_len") <= limit)
    l, r = F.col("left_"), F.col("right_")
    line = l["value"] + (r["value"] - l["value"]) * (F.col("idx") - l["idx"]) / (r["idx"] - l["idx"])
    out = classified.withColumn("is_interpolated", short)
    return out.withColumn("value", F.when(short & l.isNotNull(), F.coalesce(line, l["value"])).otherwise(F.col("value"))).drop("left_", "right_", "valid")


def sane(grid: DataFrame, low: float = 0.0, high: float = MAX_REASONABLE) -> DataFrame:
    """grid with values out of [low, high] made null, and is_bad marking them."""
    bad = F.col("value").isNotNull() & ~F.col("value").between(low, high)
    return grid.withColumn("is_bad", bad).withColumn("value", F.when(~bad, F.col("value")))


def regularize(samples: DataFrame, bounds: tuple[float, float] | None = (0.0, MAX_REASONABLE), min_samples: int = MIN_ERA_SAMPLES, limit: int = SHORT_GAP_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(grid, era report) of raw samples with one value column.

    grid: series_id, era_id, ts, value, is_interpolated, is_marker; between
    eras that leave room one marker row with a null value, midway.
    """
    raw = materialized(deduplicate(samples), "samples")  # eras and grid both read it
    eras = detect_eras(raw, min_samples)
    rows = Ordered(with_micros(raw).select("series_id", "us", "value"), ["series_id"]).index("idx").done()
    e = eras.select(F.col("series_id").alias("s"), "era_id", "from_idx", "to_idx", F.round(F.col("freq_hours") * 3.6e9).cast("long").alias("freq_us"))
    tagged = rows.join(e, (F.col("series_id") == F.col("s")) & (F.col("idx") >= F.col("from_idx")) & (F.col("idx") < F.col("to_idx"))).drop("s", "from_idx", "to_idx", "idx")
    grid = dense_grid(snap(tagged)).withColumn("was_null", F.col("value").isNull())
    grid = sane(grid, *bounds) if bounds else grid.withColumn("is_bad", F.lit(False))
    filled = materialized(interpolate_short(classify_gaps(grid), limit), "grid")
    report = filled.groupBy("series_id", "era_id", "freq_us").agg(
        F.timestamp_micros(F.min("slot_us")).alias("start"),
        F.timestamp_micros(F.max("slot_us")).alias("end"),
        F.count(F.lit(1)).alias("n_samples_regularized"),
        F.sum(F.coalesce("collisions", F.lit(0))).alias("n_snap_collisions"),
        F.sum(F.col("was_null").cast("long")).alias("n_missing_before_clean"),
        F.sum(F.col("is_bad").cast("long")).alias("n_sanity_flagged_bad"),
        F.sum(F.col("is_interpolated").cast("long")).alias("n_short_gap_interpolated"),
        F.sum((F.col("gap_len") > limit).cast("long")).alias("n_long_gap_left"),
        F.max("gap_len").alias("longest_gap_samples"),
    )
    report = report.withColumn("longest_gap_hours", F.round(F.col("longest_gap_samples") * F.col("freq_us") / 3.6e9, 2))
    by = Window.partitionBy("series_id").orderBy("era_id")
    ends = report.withColumn("next_start", F.lead("start").over(by)).where("next_start > end")
    middle = (F.unix_micros("end") + F.floor((F.unix_micros("next_start") - F.unix_micros("end")) / 2)).cast("long")
    marks = ends.select("series_id", "era_id", F.timestamp_micros(middle).alias("ts"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("is_interpolated"), F.lit(True).alias("is_marker"))
    rows = filled.select("series_id", "era_id", F.timestamp_micros("slot_us").alias("ts"), "value", "is_interpolated", F.lit(False).alias("is_marker"))
    # two eras may snap to one time at their seam: the earlier era's row stays
    rows = first_in_order(rows, ["series_id", "ts"], ["era_id"])
    return rows.unionByName(marks), report


def record_report(report: DataFrame, grid: DataFrame) -> DataFrame:
    """One row a series: the era with most samples, sums and largest gaps of eras, share missing, years of record."""
    eras = report.groupBy("series_id").agg(
        F.max_by("freq_us", F.struct("n_samples_regularized", (-F.col("era_id")).alias("e"))).alias("freq_us"),
        F.count(F.lit(1)).alias("n_eras"),
        *(F.sum(c).alias(c) for c in ("n_snap_collisions", "n_missing_before_clean", "n_sanity_flagged_bad", "n_short_gap_interpolated", "n_long_gap_left")),
        F.max("longest_gap_samples").alias("longest_gap_samples"),
        F.max("longest_gap_hours").alias("longest_gap_hours"),
    )
    whole = grid.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_samples_regularized"),
        F.sum(F.col("is_marker").cast("long")).alias("n_era_boundary_markers"),
        (F.avg(F.col("value").isNull().cast("double")) * 100).alias("pct_missing_after_clean"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / (365.25 * 86_400_000_000)).alias("record_years"),
    )
    out = eras.join(whole, "series_id").withColumn("multi_era_detected", F.col("n_eras") > 1).withColumn("sampling_interval_hours", F.col("freq_us") / 3.6e9)
    return out.withColumn("n_long_gap_left", F.col("n_long_gap_left") + F.col("n_era_boundary_markers")).drop("freq_us")


def interval_audit(samples: DataFrame) -> DataFrame:
    """(series_id, year, interval_us, n_at_mode, n_steps, pct_at_mode, differs): each year's commonest step against the series'."""
    steps = Ordered(with_micros(samples).select("series_id", "us"), ["series_id"]).previous("us", "before").done().where("before is not null")
    steps = steps.select("series_id", F.year(F.timestamp_micros("us")).alias("year"), (F.col("us") - F.col("before")).alias("step"))
    counts = steps.groupBy("series_id", "year", "step").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("series_id", "year").agg(F.max(F.struct("n", (-F.col("step")).alias("m"))).alias("b"), F.sum("n").alias("n_steps"))
    whole = counts.groupBy("series_id", "step").agg(F.sum("n").alias("n")).groupBy("series_id").agg(F.max(F.struct("n", (-F.col("step")).alias("m"))).alias("w"))
    out = best.join(whole, "series_id").select("series_id", "year", (-F.col("b.m")).alias("interval_us"), F.col("b.n").alias("n_at_mode"), "n_steps", F.round(100 * F.col("b.n") / F.col("n_steps"), 1).alias("pct_at_mode"), (F.col("b.m") != F.col("w.m")).alias("differs"))
    return out


def qc_audit(samples: DataFrame, qc: str = "qc") -> DataFrame:
    """(series_id, year, flag, n, share, n_finite, lo, hi, mean): counts of quality flags by year and the values under each."""
    by = samples.groupBy("series_id", F.year("ts").alias("year"), F.col(qc).alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_finite"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("series_id", "year")))


def position_audit(fixes: DataFrame) -> DataFrame:
    """(series_id, lat, lon, shifted_years) of fixes with ts, lat, lon: the commonest place to three decimals and the years with another."""
    at = fixes.select("series_id", F.year("ts").alias("year"), F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"))
    counts = at.groupBy("series_id", "lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("series_id").agg(F.max(F.struct("n", (-F.col("lat")).alias("a"), (-F.col("lon")).alias("o"))).alias("b")).select("series_id", (-F.col("b.a")).alias("mode_lat"), (-F.col("b.o")).alias("mode_lon"))
    off = at.join(best, "series_id").groupBy("series_id", "mode_lat", "mode_lon")
    return off.agg(F.sort_array(F.collect_set(F.when((F.col("lat") != F.col("mode_lat")) | (F.col("lon") != F.col("mode_lon")), F.col("year")))).alias("shifted_years")).withColumnRenamed("mode_lat", "lat").withColumnRenamed("mode_lon", "lon")
