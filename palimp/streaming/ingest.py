"""Continuous ingest: new text files become paragraph rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimp.sources.txt import split_texts


def text_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of paragraph rows of the text files in a folder; each file is taken once."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return split_texts(files.select(F.col("_metadata.file_path").alias("path"), "value"), "path", "value")


def latest_changes(changes: DataFrame, delay: str = "30 days") -> DataFrame:
    """A stream of change rows without those delivered again within the delay (equal id), by a watermark on loaded_at."""
    return changes.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["id"])


def write_paragraphs(paragraphs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there and ends; run again, it goes on where it was."""
    return paragraphs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
