"""Cutting lineage on storage that every executor can read.

Executors may vanish at any time, so nothing here keeps its only copy on one
machine: intermediate tables go to the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of applications whose session names none (tests on one machine), by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one on a single machine and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='granary-checkpoint-')}"
        named = _own[app]
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    The result has no lineage but the file scan, so losing an executor re-reads
    files instead of recomputing ``df``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files behind a ``written`` table once nothing will read them again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
