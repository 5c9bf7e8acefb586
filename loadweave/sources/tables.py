"""Parquet tables of a directory, one file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """`directory`/`name`.parquet; the scan is pruned and filtered by Catalyst."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
