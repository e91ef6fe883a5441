"""Structured Streaming over folders of files and streams of measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transactions


def record_stream(spark: SparkSession, folder: str, pattern: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """Records of transaction files as they arrive in a folder; each file is decoded once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return transactions.decode_files(files)


def measure_windows(measures: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Count, mean and extremes of each measure by event-time window; rows later than ``late`` are left out.

    ``measures``: ts, name, value (a stream or a table).
    """
    window = F.window("ts", width)
    return measures.withWatermark("ts", late).groupBy(window.alias("w"), "name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")).select(F.col("w.start").alias("start"), "name", "n", "mean", "low", "high")
