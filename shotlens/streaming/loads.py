"""Deliveries and events as streams: partial counts of shots that are merged when read, and windows of events bounded by a watermark."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.session import ensure_checkpoint_dir


def stream_of(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """The Parquet file or folder at path as a stream with the schema it has now; a stream takes a single file only by a pattern."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader
    return reader.parquet(path if os.path.isdir(path) else f"{path[:-1]}[{path[-1]}]")


def shot_progress(rows: DataFrame) -> DataFrame:
    """Rows, frames seen and loads of each shot in rows."""
    return rows.groupBy("run_id", "shot_id").agg(F.count("*").alias("n_rows"), F.max("frame_id").cast("int").alias("last_frame"), F.min("load_id").alias("first_load"), F.max("load_id").alias("last_load"))


def merged_progress(parts: DataFrame) -> DataFrame:
    """shot_progress of everything, from its results over parts."""
    return parts.groupBy("run_id", "shot_id").agg(F.sum("n_rows").alias("n_rows"), F.max("last_frame").alias("last_frame"), F.min("first_load").alias("first_load"), F.max("last_load").alias("last_load"))


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events, users and total value per window and type; an event that comes later than ``late`` after the latest one is not counted any more."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return x.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum(F.floor(F.col("value") * 100 + 0.5)).alias("cents")).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "cents")


def _run(stream: DataFrame, mode: str, of: Callable[[DataFrame], DataFrame]) -> tuple[SparkSession, str]:
    """Runs over what is there; each batch writes a folder of its own, so that a batch that runs again replaces its result."""
    base = os.path.join(ensure_checkpoint_dir(stream.sparkSession), f"stream-{uuid.uuid4().hex}")

    def keep(batch: DataFrame, number: int) -> None:
        of(batch).write.mode("overwrite").parquet(f"{base}/result/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return stream.sparkSession, f"{base}/result"


def run_partials(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Keeps no state: the partial result of each batch is written, and merged when it is read."""
    spark, out = _run(stream, "append", partial)
    return merge(spark.read.option("basePath", out).parquet(out).drop("batch"))


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last value of every key of an aggregate with a watermark: state ends with its window, and late rows are dropped."""
    spark, out = _run(stream, "update", lambda batch: batch)
    values = [c for c in stream.columns if c not in keys]
    x = spark.read.option("basePath", out).parquet(out)
    return x.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("x")).select(*keys, *[f"x.{c}" for c in values])
