"""Tables that are written once and read back, so that no pass over documents runs twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder in the one that all executors share (spark.checkpoint.dir).

    Only a local session may leave that unset; then one under /tmp/checkpoints serves.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to two tasks a core. For narrow rows (keys) ahead of much work a row: a small file alone would be one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to a shared folder and reads it back. Cuts the lineage: a lost executor costs one read."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
