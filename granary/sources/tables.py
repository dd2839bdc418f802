"""Named-table access: one function so every query reads its inputs the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` under ``sf_dir``.  Any scheme Spark's readers accept works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
