"""Streams of events: windowed counts with late rows, and an aoristic timeline kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aeonframe.operators.intervals import expand, with_ordinals


def events(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """By window and keys: rows; rows later than `late` behind the newest are left out and state before that goes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def running_timeline(stream: DataFrame, *by: str) -> DataFrame:
    """By keys and bin: expected records so far; state grows with keys and bins, not with records."""
    return expand(with_ordinals(stream)).groupBy(*by, "ord").agg(F.sum("w").alias("expected"))


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str) -> None:
    """All that has arrived, into a table in memory; goes on from the checkpoint."""
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
