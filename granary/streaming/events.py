"""Windowed counts of events, as a stream or over a table by the same code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def windowed(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Events per tumbling window and type. On a stream, `late` is how late events may come; later ones are dropped."""
    held = events.withColumn("at", F.col("ts").cast("timestamp"))
    held = held.withWatermark("at", late) if late else held
    counted = held.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(24,4)")).cast("double").alias("total"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """The Parquet files that appear in a folder, as a stream."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Takes all that is there through the stream and stops; a restart goes on from the checkpoint, writing nothing twice."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
