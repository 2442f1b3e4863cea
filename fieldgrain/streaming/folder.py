"""Continuous ingest: new images of a folder become rows of summaries; each file once, with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.segment import SegmentParams, analyze

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, params: SegmentParams | None = None, files_at_once: int = 64) -> DataFrame:
    """A streaming frame with a row per new image: path, width, height, error, n_objects, threshold, objects."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).load(folder)
    return analyze(files, params).drop("label_plane", "mask_png", "annotated_png")


def start(frame: DataFrame, out: str, checkpoint: str):
    """Append to parquet, exactly once."""
    return frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
