"""The analysis of a record as a chain: each stage reads the tables that earlier stages wrote.

samples -> clean (regular grid) -> notch (daily harmonics taken out) -> transform
(power transform, residuals about the mean) -> whiteness (Ljung-Box and ARCH-LM of
the residuals); clean -> dependence (timescales of its stretches) -> extremes
(peaks as far apart as the dependence asks) and intervals (block resamples as
long as the dependence asks).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import estimators as E
from ..operators import regularize, segments, stats
from ..sources.sinks import write_stage
from .series_queries import Query, _R4, hourly, off_ties

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Settings:
    """Bounds of sane values, shortest run of an era, hours of a step, daily harmonics, quantile of the peaks' threshold, shortest stretch."""

    bounds: tuple[float, float] | None = None
    era_samples: int = 12
    dt_hours: float = 1.0
    harmonics: int = 2
    quantile: float = 0.9
    stretch: int = 48


def clean(t: Tables, o: Settings) -> DataFrame:
    grid, _ = regularize.regularize(t["samples"], o.bounds, o.era_samples)
    return grid.where("not is_marker").select("series_id", "era_id", "ts", "value")


def notch(t: Tables, o: Settings) -> DataFrame:
    rows = stats.harmonic_regression(t["clean"].select("series_id", "ts", "value"), [(24.0, o.harmonics)])
    mean = t["clean"].groupBy("series_id").agg(F.avg("value").alias("mean"))
    return rows.join(mean, "series_id").select("series_id", "ts", "value", (F.col("residual") + F.col("mean")).alias("level"))


def transform(t: Tables, o: Settings) -> DataFrame:
    rows = E.box_cox(t["notch"].where("level is not null").select("series_id", "ts", F.col("level").alias("value")), ["series_id"])
    mean = rows.groupBy("series_id").agg(F.avg("transformed").alias("mean"))
    return rows.join(mean, "series_id").select("series_id", "ts", "transformed", "lambda", (F.col("transformed") - F.col("mean")).alias("residual"))


def whiteness(t: Tables, o: Settings) -> DataFrame:
    return E.whiteness(t["transform"].select("series_id", "ts", F.col("residual").alias("value")), ["series_id"])


def dependence(t: Tables, o: Settings) -> DataFrame:
    runs = segments.label_runs(t["clean"].select("series_id", "ts", "value"))
    long = runs.groupBy("series_id", "seg_id").agg(F.count(F.lit(1)).alias("len")).where(F.col("len") >= o.stretch)
    return E.dependence_summary(E.timescales(runs.join(long, ["series_id", "seg_id"]), ["series_id", "seg_id"], o.dt_hours), o.dt_hours)


def extremes(t: Tables, o: Settings) -> DataFrame:
    apart = F.greatest(F.lit(1), F.ceil(F.col("decluster_hours") / o.dt_hours)).cast("int").alias("distance")
    u = t["clean"].groupBy("series_id").agg(F.percentile("value", o.quantile).alias("threshold")).join(t["dependence"].select("series_id", apart), "series_id")
    return E.gpd(E.declustered_peaks(t["clean"].select("series_id", "ts", "value"), u), u)


def intervals(t: Tables, o: Settings) -> DataFrame:
    rows = t["clean"].where("value is not null").join(t["dependence"].select("series_id", F.col("block_length").alias("block")), "series_id")
    return E.weibull_bootstrap(rows.select("series_id", "ts", "value", "block"), ["series_id"])


#: Stages and what each reads, in an order that respects it.
LINKS: tuple[tuple[Callable[[Tables, Settings], DataFrame], tuple[str, ...]], ...] = (
    (clean, ("samples",)), (notch, ("clean",)), (transform, ("notch",)), (whiteness, ("transform",)), (dependence, ("clean",)), (extremes, ("clean", "dependence")), (intervals, ("clean", "dependence")),
)


def run(spark: SparkSession, samples: DataFrame, root: str, settings: Settings = Settings(), last: str | None = None) -> Tables:
    """The stages' tables, each written under root and read again by those after it; samples are (series_id, ts, value). last: stop after this stage and run only what it needs."""
    needed = {f.__name__ for f, _ in LINKS}
    if last:
        needs, needed, todo = {f.__name__: n for f, n in LINKS}, set(), [last]
        while todo:
            name = todo.pop()
            if name in needs and name not in needed:
                needed.add(name)
                todo += needs[name]
    made: Tables = {"samples": samples}
    for make, reads in LINKS:
        if make.__name__ in needed:
            path = write_stage(make({k: made[k] for k in reads}, settings), root, make.__name__)
            made[make.__name__] = spark.read.parquet(path)
    return made


def _chained(spark: SparkSession, d: str, last: str) -> DataFrame:
    from ..session import new_path

    return run(spark, hourly(spark, d).where("value is not null").select("series_id", "ts", "value"), new_path(spark, "chain"), last=last)[last]


def chained_dependence(spark, d):
    """Timescales of the cleaned record."""
    out = _chained(spark, d, "dependence")
    return out.select("series_id", off_ties("tau_hours", 5).alias("tau_hours"), off_ties("lag1", 6).alias("lag1"), "block_length")


def chained_extremes(spark, d):
    """Tails of peaks as far apart as the record's dependence asks."""
    return _chained(spark, d, "extremes").select("series_id", "n_peaks", off_ties("xi", 3).alias("xi"), off_ties("sigma", 2).alias("sigma"), "few")


def chained_whiteness(spark, d):
    """Whether the transformed residuals are white, and their variance constant."""
    return _chained(spark, d, "whiteness")


def _sql() -> dict[str, str]:
    from .estimator_sql import _SEGMENT_SCALES

    # on an hourly record the cleaned grid is the hourly grid with its short gaps filled
    return {"chained_dependence": f"WITH {_SEGMENT_SCALES}, d AS (SELECT series_id, sum(n * tau) / sum(n) AS tau, sum(n * lag1) / sum(n) AS lag1 FROM ts GROUP BY series_id) SELECT series_id, {_R4('tau', 5)} AS tau_hours, {_R4('lag1', 6)} AS lag1, greatest(1, ceil(tau))::BIGINT AS block_length FROM d"}


CHAINED: dict[str, tuple[Query, str | None]] = {f.__name__: (f, _sql().get(f.__name__)) for f in (chained_dependence, chained_extremes, chained_whiteness)}
