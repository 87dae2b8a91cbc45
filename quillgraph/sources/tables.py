"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, be it one parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
