"""The analysis as a declared list of stages: what each needs, what feeds it, how it runs, and the run log."""

from __future__ import annotations

import datetime
import platform
import subprocess
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """name; after: stages that must come first; what a series must offer; query: the registered query that stands for it."""

    name: str
    query: str
    after: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    min_years: float = 0.0


STAGES = (
    Stage("clean", "short_gaps"),
    Stage("overview", "partial_autocorrelation", ("clean",)),
    Stage("stationarity", "stationarity", ("clean",)),
    Stage("notch", "harmonic_residuals", ("clean",)),
    Stage("dependence", "dependence", ("notch",)),
    Stage("transform", "power_transform", ("notch",)),
    Stage("whiteness", "whiteness", ("transform",)),
    Stage("distribution", "distribution_fits", ("clean",)),
    Stage("volatility", "whiteness", ("transform",)),
    Stage("extremes", "extreme_fits", ("dependence",)),
    Stage("variables", "components", ("clean",), any_of=("period", "direction")),
    Stage("regimes", "regimes", ("clean",), all_of=("height",)),
    Stage("intervals", "resampled_intervals", ("extremes", "dependence")),
    Stage("stability", "largest_left_out", ("intervals", "regimes")),
    Stage("network", "pairwise_correlation", ("clean",)),
    Stage("network_intervals", "correlation_intervals", ("network", "dependence")),
    Stage("trend", "kendall_trend", ("clean",), min_years=10.0),
    Stage("seasonal", "seasonal_decomposition", ("clean",), min_years=2.0),
    Stage("driver", "lagged_correlation", ("clean", "regimes")),
    Stage("persistence", "persistence_summary", ("clean",)),
    Stage("arma", "arma_backtest", ("persistence",)),
    Stage("garch", "garch_backtest", ("arma",)),
    Stage("armax", "driven_backtest", ("arma",)),
    Stage("exceedance", "exceedance_forecast", ("clean",)),
    Stage("report", "network_report", ("clean", "stationarity", "distribution", "extremes", "dependence")),
    Stage("fingerprint", "fingerprints", ("clean", "extremes", "dependence", "regimes")),
    Stage("hidden_regimes", "hidden_regimes", ("clean",)),
    Stage("changes", "change_points", ("clean",), min_years=10.0),
    Stage("spectrum", "singular_spectrum", ("clean",)),
)


def ordered(stages: Iterable[Stage] = STAGES) -> list[Stage]:
    """Stages in an order that respects `after`; ValueError for a circle or an unknown name."""
    left, out, done = list(stages), [], set()
    while left:
        ready = [s for s in left if set(s.after) <= done]
        if not ready:
            raise ValueError("stages wait for each other or for unknown ones: " + ", ".join(s.name for s in left))
        out += ready
        done |= {s.name for s in ready}
        left = [s for s in left if s not in ready]
    return out


def registry(spark: SparkSession) -> DataFrame:
    """STAGES as a table."""
    rows = [(i, s.name, s.query, list(s.after), list(s.any_of), list(s.all_of), s.min_years) for i, s in enumerate(ordered())]
    return spark.createDataFrame(rows, "position int, stage string, query string, after array<string>, any_of array<string>, all_of array<string>, min_years double")


def gate(series: DataFrame, stages: DataFrame) -> DataFrame:
    """(series_id, stage, eligible, reason) of series (series_id, available_variables, record_years) and a stage registry.

    stages has a few dozen rows, so it is broadcast.
    """
    met = series.crossJoin(F.broadcast(stages.select("stage", "any_of", "all_of", "min_years")))
    no_any = (F.size("any_of") > 0) & ~F.coalesce(F.arrays_overlap("any_of", "available_variables"), F.lit(False))
    missing = F.array_except("all_of", F.coalesce("available_variables", F.array().cast("array<string>")))
    short = F.coalesce("record_years", F.lit(0.0)) < F.col("min_years")
    reason = F.when(no_any, F.concat(F.lit("needs one of "), F.concat_ws(",", "any_of"))).when(F.size(missing) > 0, F.concat(F.lit("lacks "), F.concat_ws(",", missing))).when(short, F.format_string("record is %.3f years, needs %.1f", F.coalesce("record_years", F.lit(0.0)), "min_years"))
    return met.select("series_id", "stage", reason.isNull().alias("eligible"), reason.alias("reason"))


def eligible(series: DataFrame, gates: DataFrame, stage: str) -> DataFrame:
    """The series that may run a stage (semi join)."""
    return series.join(gates.where((F.col("stage") == stage) & F.col("eligible")), "series_id", "left_semi")


def run(spark: SparkSession, sf_dir: str, queries: dict[str, Callable[[SparkSession, str], DataFrame]], root: str, names: Iterable[str] | None = None) -> DataFrame:
    """Run stages in order, each written under root, and return the log (stage, status, seconds, rows, message).

    A stage that fails is logged, and the stages that need it are skipped.
    """
    from ..sources.sinks import write_stage

    wanted = set(names) if names is not None else None
    log, failed = [], set()
    for s in ordered():
        if wanted is not None and s.name not in wanted:
            continue
        if failed & set(s.after):
            failed.add(s.name)
            log.append((s.name, "skipped", 0.0, None, "needs " + ", ".join(sorted(failed & set(s.after)))))
            continue
        began = datetime.datetime.now()
        try:
            path = write_stage(queries[s.query](spark, sf_dir), root, s.name)
            rows, status, message = spark.read.parquet(path).count(), "ok", ""
        except Exception as x:  # a stage's failure is a result of the run
            rows, status, message = None, "failed", str(x)[:300]
            failed.add(s.name)
        log.append((s.name, status, (datetime.datetime.now() - began).total_seconds(), rows, message))
    return spark.createDataFrame(log, "stage string, status string, seconds double, rows long, message string")


def provenance(spark: SparkSession) -> DataFrame:
    """One row: time, application, versions, and the revision of the working folder if git knows it."""
    try:
        revision = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or None
    except (OSError, subprocess.TimeoutExpired):
        revision = None
    versions = {"spark": pyspark.__version__, "python": platform.python_version(), "numpy": numpy.__version__}
    return spark.createDataFrame([(datetime.datetime.now(), spark.sparkContext.applicationId, revision, versions)], "at timestamp, application string, revision string, package_versions map<string,string>")


def warnings(table: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(series_id, severity, code, message, context) for each rule (severity, code, condition, message) that a row meets; context has the row's numbers."""
    numbers = [c for c, t in table.dtypes if t in ("double", "bigint", "int", "float") and c != "series_id"]
    context = F.map_from_arrays(F.array(*(F.lit(c) for c in numbers)), F.array(*(F.col(c).cast("string") for c in numbers)))
    found = F.array(*(F.when(F.expr(cond), F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"), F.lit(text).alias("message"))) for sev, code, cond, text in rules))
    return table.withColumn("w", F.explode(F.filter(found, lambda x: x.isNotNull()))).select("series_id", "w.severity", "w.code", "w.message", context.alias("context"))
