"""Session defaults and the one way this engine cuts lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "loadweave", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine expects: UTC, AQE, ANSI left as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without one (tests) gets a folder of this machine; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loadweave-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def spread(df: DataFrame) -> DataFrame:
    """For work in Python: a table that comes in fewer tasks than there are cores (a file of few row groups) is dealt to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and forgets the lineage."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back.

    For intermediate results that several branches read: unlike a cache it survives executors, and
    unlike an RDD checkpoint it is columnar, compressed and can be pruned by column. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"loadweave-{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "snappy").parquet(path)
    written = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(written)
    return spark.read.schema(df.schema).parquet(path)
