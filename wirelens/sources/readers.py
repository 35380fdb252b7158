"""Batch and streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schema


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Captured wire frames. Their order is the ``frame_no`` column, not the file order."""
    return spark.read.schema(schema.FRAMES).parquet(path)


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored events: ``parquet`` (event rows), ``jsonl`` or ``json`` (exported records).

    ``json`` is a document whose ``queries`` array holds the records.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "jsonl":
        return spark.read.schema(schema.RECORD).json(path)
    if fmt == "json":
        return spark.read.schema(schema.DOCUMENT).json(path, multiLine=True).select(F.inline("queries"))
    raise ValueError(f"unknown event format: {fmt}")


def stream_events(spark: SparkSession, path: str, rows: StructType, files_per_trigger: int = 1) -> DataFrame:
    """New event files as they arrive; the checkpoint remembers what was read."""
    return spark.readStream.schema(rows).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
