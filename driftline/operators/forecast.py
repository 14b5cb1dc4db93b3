"""Forecast evaluation as joins and aggregations: persistence, rolling origins, scores, exceedance probabilities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import with_halo
from .stats import average_ranks
from .windows import trailing_rows


def persistence(indexed: DataFrame, horizons: list[int], step: int, min_history: int, max_lookback: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, origin_idx, horizon_samples, actual, predicted, error) of rolling origins.

    indexed: keys, idx, us, value with missing values as nulls. An origin is
    the last observed row; its forecast is the last valid value at most
    max_lookback rows back. Targets that are missing or past the end are left out.
    """
    keys = keys or ["series_id"]
    held = indexed.withColumn("__h", F.when(F.col("value").isNotNull(), F.struct("idx", "value")))
    rows = trailing_rows(held, max_lookback + 1, {"held": F.last("__h", ignorenulls=True)}, keys)
    origins = rows.where((F.col("idx") >= min_history) & ((F.col("idx") - min_history) % step == 0) & F.col("held").isNotNull())
    asks = origins.select(*keys, F.col("idx").alias("origin_idx"), F.col("held.value").alias("predicted"), F.explode(F.array(*(F.lit(h) for h in horizons))).alias("horizon_samples"))
    return _with_actual(asks, indexed, keys)


def _with_actual(asks: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    asks = asks.withColumn("at", F.col("origin_idx") + F.col("horizon_samples"))
    actual = indexed.where("value is not null").select(*keys, F.col("idx").alias("at"), F.col("value").alias("actual"))
    return asks.join(actual, [*keys, "at"]).select(*keys, "origin_idx", "horizon_samples", "actual", "predicted", (F.col("actual") - F.col("predicted")).alias("error"))


def rolling_origin(indexed: DataFrame, forecast_fn: Callable[[np.ndarray, list[int]], Sequence[float | None]], horizons: list[int], step: int, min_history: int, history: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, origin_idx, horizon_samples, actual, predicted, error) of any forecast function over rolling origins.

    forecast_fn(values, horizons) gets the last `history` values up to and with
    the origin, missing ones as NaN, and gives a value for each horizon; None
    or NaN gives no row. Series are cut into chunks with as much history, so a
    long one spreads over tasks.
    """
    keys = keys or ["series_id"]
    types = dict(indexed.dtypes)
    rows = with_halo(indexed.select(*keys, F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")), "idx", max(4096, history), back=history - 1)
    shape = ", ".join([*(f"{k} {types[k]}" for k in keys), "origin_idx long, horizon_samples int, predicted double"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        at, x, own = pdf["idx"].to_numpy(), pdf["value"].to_numpy(), pdf["__own"].to_numpy()
        out = []
        for i in np.flatnonzero(own & (at >= min_history) & ((at - min_history) % step == 0)):
            got = forecast_fn(x[max(0, i + 1 - history) : i + 1], horizons)
            out += [(*key[:-1], int(at[i]), h, float(v)) for h, v in zip(horizons, got) if v is not None and v == v]
        return pd.DataFrame(out, columns=[*keys, "origin_idx", "horizon_samples", "predicted"])

    return _with_actual(rows.groupBy(*keys, "__chunk").applyInPandas(run, shape), indexed, keys)


def summarize(backtest: DataFrame, dt_hours: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, horizon_samples, horizon_hours, n, rmse, mae, mse)."""
    keys = keys or ["series_id"]
    e = F.col("error")
    out = backtest.groupBy(*keys, "horizon_samples").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))
    return out.withColumn("rmse", F.sqrt("mse")).withColumn("horizon_hours", F.col("horizon_samples") * F.lit(dt_hours))


def skill(model: DataFrame, baseline: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, horizon_samples, skill): 1 - mse of the model over mse of the baseline."""
    keys = [*(keys or ["series_id"]), "horizon_samples"]
    return model.select(*keys, F.col("mse").alias("m")).join(baseline.select(*keys, F.col("mse").alias("b")), keys).select(*keys, (1 - F.col("m") / F.col("b")).alias("skill"))


def interval_coverage(backtest: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, horizon, coverage, mean_width) of forecasts with half_width."""
    keys = [*(keys or ["series_id"]), "horizon"]
    return backtest.groupBy(*keys).agg(F.avg((F.abs("error") <= F.col("half_width")).cast("double")).alias("coverage"), F.avg(2 * F.col("half_width")).alias("mean_width"))


def brier(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, brier, baseline, skill) of p and label; the baseline forecasts the share of label 1."""
    out = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2.0))).alias("brier"), F.avg(F.col("label").cast("double")).alias("share"))
    base = F.col("share") * (1 - F.col("share"))
    return out.withColumn("baseline", base).withColumn("skill", F.when(base > 0, 1 - F.col("brier") / base)).drop("share")


def roc_auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auc): Mann-Whitney statistic with average ranks; null with one label only."""
    ranked = average_ranks(scored, keys, "p", "rank")
    got = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("label") == 1, F.col("rank"))).alias("r"), F.sum(F.col("label").cast("long")).alias("a"), F.sum(1 - F.col("label").cast("long")).alias("b"))
    auc = (F.col("r") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * F.col("b"))
    return got.select(*keys, F.when((F.col("a") > 0) & (F.col("b") > 0), auc).alias("auc"))


def local_baseline(segment_backtest: DataFrame, persisted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """persisted's rows at the origins and horizons of a model's backtest, so that both are scored alike."""
    keys = [*(keys or ["series_id"]), "origin_idx"]
    model = segment_backtest.select(*keys, F.col("horizon").alias("horizon_samples")).distinct()
    return persisted.join(model, [*keys, "horizon_samples"], "left_semi")


def rank_within(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
