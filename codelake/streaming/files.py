"""Structured Streaming over folders that files arrive in; decoding is stateless, so any trigger and restart is safe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelake.operators.decode import decode


def decode_stream(spark: SparkSession, path: str, mode: str = "permissive", files_per_trigger: int = 1000) -> DataFrame:
    """A streaming table (path, width, height, components, …) of the files that appear below ``path``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return decode(files.select("path", "content"), ["path"], mode)
