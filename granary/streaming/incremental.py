"""Incremental work: files that arrive become work, done work is left out, results are appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there and holds data files, on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.exists(folder) and any(not f.getPath().getName().startswith(("_", ".")) for f in store.listStatus(folder))


def run_available(spark: SparkSession, source: str, schema: str, results: str, checkpoint: str, identity: list[str], work: Callable[[DataFrame], DataFrame], files_per_trigger: int = 64) -> None:
    """Runs ``work`` over rows of new Parquet files under ``source`` whose identity ``results`` does not have.

    One call handles all that is there and ends; the checkpoint remembers files, and the
    anti join remembers rows, so a batch that is repeated after a failure adds nothing twice.
    """

    def batch(rows: DataFrame, _: int) -> None:
        fresh = rows.dropDuplicates(identity)
        if has_data(spark, results):
            fresh = fresh.join(spark.read.parquet(results).select(*identity).distinct(), identity, "left_anti")
        work(fresh).write.mode("append").parquet(results)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by tumbling window and keys with a watermark; works on streams and tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")
