"""Incremental reading of profile shards and event-time aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_profiles(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Shards as a stream of rows: new files are picked up in bounded micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all that is there now and stop; the checkpoint makes a later run go on where this one ended."""
    query = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_totals(readings: DataFrame, ts: str, key: str, value: str, width: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Totals per key and half-hour of event time; rows later than the watermark are dropped. NTZ times are cast first."""
    timed = readings.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
