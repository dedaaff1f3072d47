"""Parquet inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def parquet_tables(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """A reader of ``<folder>/<name>.parquet`` by name."""
    return lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
