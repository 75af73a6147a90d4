"""Streams: event-time windows, sessions, append of results, storage state carried between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def read_stream(spark: SparkSession, path: str, like: DataFrame, ts: str | None = None, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream; a time without zone becomes a timestamp, which watermarks need."""
    df = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if ts else df


def tumbling(df: DataFrame, ts: str, keys: list[str], value: str, size: str, late: str) -> DataFrame:
    """Block sums, means and counts by event time; rows later than ``late`` are dropped."""
    w = df.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *keys)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "total", "mean")


def sliding(df: DataFrame, ts: str, keys: list[str], value: str, size: str, step: str, late: str) -> DataFrame:
    w = df.withWatermark(ts, late).groupBy(F.window(ts, size, step).alias("w"), *keys)
    return w.agg(F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "total")


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    src = df.withWatermark(ts, late) if late else df
    s = src.groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count("*").alias("n"))
    return s.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *keys, "n")


def append_results(df: DataFrame, path: str, checkpoint: str, partitions: list[str]) -> Any:
    """A query that appends each batch under its own number; a batch that is written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *partitions).parquet(path)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def storage_state(df: DataFrame, key: str, t: str, charge: str, discharge: str, initial: float, capacity: float, eta_in: float, eta_out: float) -> DataFrame:
    """State of charge by unit, kept between batches and held within 0..capacity."""
    kinds = dict(df.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else initial
        for p in frames:
            p = p.sort_values(t)
            out = []
            for c, d in zip(p[charge], p[discharge], strict=True):
                level = min(capacity, max(0.0, level + eta_in * c - d / eta_out))
                out.append(level)
            yield pd.DataFrame({key: k[0], t: p[t], "soc": out})
        state.update((level,))

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {t} {kinds[t]}, soc double", "level double", "append", "NoTimeout")


class Progress(StreamingQueryListener):
    """Calls back with the name, batch and number of rows of every batch."""

    def __init__(self, callback: Callable[[str, int, int], None]):
        self.callback = callback

    def onQueryStarted(self, event: Any) -> None:
        self.callback(event.name or "", -1, 0)

    def onQueryProgress(self, event: Any) -> None:
        self.callback(event.progress.name or "", event.progress.batchId, event.progress.numInputRows)

    def onQueryTerminated(self, event: Any) -> None: ...
