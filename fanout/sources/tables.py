"""The given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def utc(column: str):
    """A zone-less timestamp read as UTC."""
    return F.col(column).cast("timestamp")


def spread(ids: DataFrame) -> DataFrame:
    """Ids dealt evenly to as many tasks as there are cores: each is about to become many rows."""
    return ids.repartition(ids.sparkSession.sparkContext.defaultParallelism)
