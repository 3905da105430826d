"""Readers for the tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the dataset folder, by Spark's own reader."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
