"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
