"""Readers and writers of readings, profiles, stats and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READINGS = T.StructType([T.StructField(n, T.StringType()) for n in ("LCLid", "stdorToU", "DateTime", "kwh")])


def read_readings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw readings with an explicit schema (no inference pass); the value column is renamed by position, whatever its header."""
    return spark.read.schema(READINGS).option("header", True).option("enforceSchema", True).csv(path)


def write_profiles(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_profiles_csv(df: DataFrame, path: str, array: str = "kwh") -> None:
    """Arrays as JSON text, for exchange."""
    df.withColumn(array, F.to_json(array)).write.mode("overwrite").option("header", True).csv(path)


def read_profiles_csv(spark: SparkSession, path: str, schema: str, array: str = "kwh") -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path).withColumn(array, F.from_json(array, "array<double>"))


def shard_assignment(df: DataFrame, key: str, shards: int, seed: int = 0) -> DataFrame:
    """Adds shard 0..shards-1: rows in hash order cut into equal runs, none dropped (the first n mod shards get one more)."""
    from loadweave.operators.ordering import shuffle_positions

    n = df.count()
    size, more = divmod(n, shards)
    pos = F.col("_lw_pos") - 1
    edge = more * (size + 1)
    shard = F.when(pos < edge, F.floor(pos / F.lit(size + 1))).otherwise(F.lit(more) + F.floor((pos - edge) / F.lit(max(size, 1))))
    return shuffle_positions(df, key, seed, "_lw_pos").withColumn("shard", shard.cast("int")).drop("_lw_pos")


def write_shards(df: DataFrame, path: str, key: str, shards: int, seed: int = 0) -> None:
    shard_assignment(df, key, shards, seed).repartition(shards, "shard").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, subsample: float = 1.0, seed: int = 0, key: str = "profile_id", batch: int | None = None, shuffle: bool = False, drop_last: bool = False) -> DataFrame:
    """Rows of all shards. A subsample has exactly floor(share * rows) rows; shuffle adds pos, batch adds batch_id as well."""
    from loadweave.operators import ordering

    df = spark.read.parquet(path)
    if subsample < 1:
        df = ordering.exact_sample(df, key, int(subsample * df.count()), seed)
    if batch is not None:
        return ordering.batches(df, key, batch, seed + 1, drop_last)
    return ordering.shuffle_positions(df, key, seed + 1) if shuffle else df
