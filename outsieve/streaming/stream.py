"""Structured Streaming: inspection is map-only, so a stream of responses equals the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.inspect import inspect
from ..sources.io import REQUEST


def responses(spark: SparkSession, path: str, schema: str = REQUEST, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def inspected(stream: DataFrame, **how) -> DataFrame:
    return inspect(stream, **how)


def windowed_counts(stream: DataFrame, time: str, length: str, late: str, *by: str) -> DataFrame:
    """Counts per window, closed once the watermark passes it."""
    got = stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *by).agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("start"), *by, "n")


def to_sink(stream: DataFrame, write, checkpoint: str, every: str = "5 seconds"):
    """Each micro-batch through ``write(df, batch_id)``: at least once, by the checkpoint."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
