"""Windowed totals of an event table; the same function serves a batch and a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def hourly_totals(events: DataFrame, late: str | None = None) -> DataFrame:
    """Count and total of each event type and hour. With ``late`` (a stream), events later than that are left out and state is dropped."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select("event_type", F.col("w.start").alias("hour_start"), "n", "total")


def read_event_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """Files of a folder as a stream of events; timestamps become zoned, as watermarks need."""
    s = spark.readStream.schema(like.schema).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))
