"""Session set-up and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def build_session(app: str = "driftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; conf overrides by full key."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows may hold whole texts, so batches of rows are kept small where they cross to Python or come from Parquet.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def prepare(spark: SparkSession) -> None:
    """Make a session ready: small batches, and this package on the executors."""
    for key, value in BATCH_ROWS.items():
        spark.conf.set(key, value)
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="driftline-"), "driftline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; where that is unset, one of our own if all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or '/tmp/driftline').rstrip('/')}/driftline/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
