"""Progress logs (JSON lines) as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp timestamp, event string, case_id string, run_id string, detail string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def progress(events: DataFrame, lateness: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events by kind and window; later ones than the watermark are dropped."""
    return events.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", window), "event").agg(F.count("*").alias("n")).select("window.start", "event", "n")
