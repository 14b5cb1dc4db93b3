"""The batch operators that make sense on a stream: tumbling and session windows, deduplication, last-value state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import new_path


def read_samples(spark: SparkSession, folder: str, schema: str, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)


def tumbling(samples: DataFrame, width: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """(series_id, start, mean, max, n) of closed windows; rows later than `late` are dropped."""
    by = samples.withWatermark("ts", late).groupBy(F.window("ts", width), "series_id")
    return by.agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.count("value").alias("n")).select("series_id", F.col("window.start").alias("start"), "mean", "max", "n")


def sessions(samples: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(series_id, start, end, n) of stretches without a longer gap."""
    by = samples.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "series_id")
    return by.agg(F.count(F.lit(1)).alias("n")).select("series_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(samples: DataFrame, late: str = "1 hour") -> DataFrame:
    return samples.withWatermark("ts", late).dropDuplicatesWithinWatermark(["series_id", "ts"])


def last_values(samples: DataFrame) -> DataFrame:
    """(series_id, ts, value): after each batch the newest valid value of each series that got rows (persistence state)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, value = state.get if state.exists else (None, None)
        for pdf in frames:
            pdf = pdf.dropna(subset=["value"])
            if len(pdf):
                row = pdf.loc[pdf["ts"].idxmax()]
                if at is None or row["ts"] >= pd.Timestamp(at):
                    at, value = row["ts"].to_pydatetime(), float(row["value"])
        if at is not None:
            state.update((at, value))
            yield pd.DataFrame({"series_id": [key[0]], "ts": [at], "value": [value]})

    return samples.groupBy("series_id").applyInPandasWithState(update, "series_id string, ts timestamp, value double", "ts timestamp, value double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The rows that a stream of finished files gives. Each batch is a table of its own in the shared folder, written anew if the batch runs again."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    query = stream.writeStream.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}"))
    query = query.option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/batch=*") if query.lastProgress else spark.createDataFrame([], stream.schema)
