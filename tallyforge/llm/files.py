"""Binary files through Spark's own writers and readers, so any file system that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_frames(frames: DataFrame, path: str, marker: str, most: int) -> None:
    """The binary `value` of each partition's rows in order, each followed by marker, `most` rows a file.

    The text writer writes a string's bytes as they are; the marker, its line separator, must mean nothing in the
    format written.
    """
    frames.select(F.col("value").cast("string").alias("value")).write.option("lineSep", marker).option("maxRecordsPerFile", most).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files under path, whole."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
