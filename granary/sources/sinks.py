"""Sinks: a table and its one-row summary, published together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.audit import content_digest


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes Parquet to a fresh path (the committer's marker comes last) and returns what was written."""
    df.write.mode("errorifexists").partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_with_summary(df: DataFrame, path: str, version: str) -> DataFrame:
    """Writes ``<path>/table`` and ``<path>/summary`` with row count, digest and a version; returns the summary."""
    table = write_table(df, f"{path}/table")
    summary = content_digest(table).withColumn("schema_version", F.lit(version))
    return write_table(summary, f"{path}/summary")


def write_tsv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Tab-separated text with a header; arrays must be joined first, nulls are empty.

    With ``order``, rows ascend within each file and from file to file.
    """
    df = df.orderBy(*order) if order else df
    df.write.mode("errorifexists").options(sep="\t", header=True, lineSep="\n", emptyValue="", quote="").csv(path)


def write_shards(df: DataFrame, path: str, shard: str) -> None:
    """One folder per shard; rows move once, by shard."""
    df.repartition(shard).write.mode("errorifexists").partitionBy(shard).parquet(path)
