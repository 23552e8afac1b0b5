"""Reading the named tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table name in folder, by Spark's own reader, so that any store it knows will do."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
