"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the session's checkpoint folder (else the warehouse); it goes when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    spot = spark._jvm.org.apache.hadoop.fs.Path(path)
    spot.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(spot)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written out and read again: a short lineage, and a short plan for what follows. What this returned before is not written twice."""
    if "_written_at" in vars(df):
        return df
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out
