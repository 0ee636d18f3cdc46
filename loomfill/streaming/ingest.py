"""Extension: samples that keep arriving, by Structured Streaming.

The same Column functions serve here; only the source and the state differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfill.functions.text import format_training
from loomfill.sources.corpora import SAMPLE


def sample_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Samples of JSON files as they appear in a folder."""
    rows = spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return rows.select(F.col("filePath").alias("file_path"), "prefix", "middle", "suffix", F.col("nodeType").alias("node_type"))


def training_stream(samples: DataFrame) -> DataFrame:
    return samples.select(format_training(F.col("prefix"), F.col("middle"), F.col("suffix")).alias("text"))


def arrival_counts(events: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes", by: str = "node_type") -> DataFrame:
    """Counts per window and kind; rows later than ``late`` are left out and windows are then final."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))


def write_batches(samples: DataFrame, out: str, checkpoint: str):
    """Training text of each micro-batch as files; a batch is written under its number, so a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        training_stream(batch).write.mode("overwrite").text(f"{out}/batch={number}")

    return samples.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
