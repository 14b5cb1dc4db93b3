"""Sinks: tables by stage and series, JSON summaries, text reports, an append-only run log."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_path(root: str, stage: str) -> str:
    return f"{root.rstrip('/')}/stage={stage}"


def write_stage(df: DataFrame, root: str, stage: str, by: list[str] | None = None, kind: str = "parquet") -> str:
    """Write a stage's table, partitioned by `by` (one shuffle, so that each partition is a few files); returns its path."""
    path = stage_path(root, stage)
    rows = df.repartition(*by) if by else df
    writer = rows.write.mode("overwrite").format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)
    return path


def write_summary(df: DataFrame, root: str, stage: str) -> str:
    """One JSON object a row, nested columns kept."""
    path = f"{stage_path(root, stage)}_summary"
    df.write.mode("overwrite").json(path)
    return path


def write_report(df: DataFrame, path: str, column: str = "report") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def log_run(spark: SparkSession, path: str, unit: str, status: str, message: str = "") -> None:
    """Append one line to the run log."""
    row = [(datetime.datetime.now(datetime.timezone.utc), unit, status, message)]
    spark.createDataFrame(row, "at timestamp, unit string, status string, message string").coalesce(1).write.mode("append").parquet(path)


def existing_partitions(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a partition column that a written table already has, from its folders; [] if there is no table."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))
