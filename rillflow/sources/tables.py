"""Parquet tables, read whole or replayed as a bounded stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import is_directory


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def replay(spark: SparkSession, folder: str, name: str, max_bytes: int | None = None) -> DataFrame:
    """The table as a stream with the same rows.

    A table that is a folder of part files is watched itself; a single file is
    picked out of its parent by name, as file streams only watch folders.
    ``max_bytes`` bounds each micro-batch.
    """
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if is_directory(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
