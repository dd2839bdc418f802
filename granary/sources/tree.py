"""File trees as inventory tables."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.keys import file_type, redacted_link

_SCHEMA = "relative_path string, kind string, size_bytes long, mtime_ns long, mode string, link_target string"


def _entries(root: str, below: str = "") -> Iterator[tuple]:
    for e in sorted(os.scandir(os.path.join(root, below)), key=lambda e: e.name):
        info, path = e.stat(follow_symlinks=False), os.path.join(below, e.name)
        mode = stat.filemode(info.st_mode)
        if e.is_symlink():
            yield path, "symlink", 0, info.st_mtime_ns, mode, os.readlink(e.path)
        elif e.is_dir(follow_symlinks=False):
            yield from _entries(root, path)
        else:
            plain = e.is_file(follow_symlinks=False)
            yield path, "file" if plain else "special", info.st_size if plain else 0, info.st_mtime_ns, mode, ""


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files, links and special files below a folder the driver can see; links are never followed."""
    if not os.path.isdir(root) or os.path.islink(root):
        raise ValueError(f"not a real folder: {root}")
    rows = spark.createDataFrame(list(_entries(root)), _SCHEMA)
    kind = F.when(F.col("kind") == "special", "other").otherwise(file_type(F.col("relative_path")))
    return rows.withColumns({"file_type": kind, "link_target": redacted_link(F.col("link_target"))})


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, modified, file_type) of files in any store Spark reads; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), file_type(F.col("path")).alias("file_type"))


def confined(root: str, path: str) -> str:
    """The real path of ``path`` below ``root``; absolute paths, parents and links that lead out are an error."""
    real = os.path.realpath(os.path.join(root, path))
    if os.path.isabs(path) or ".." in path.split("/") or os.path.commonpath([real, os.path.realpath(root)]) != os.path.realpath(root):
        raise ValueError(f"path leads out of its folder: {path}")
    return real


def archives(inventory: DataFrame) -> DataFrame:
    """Plain files that are archives, by path."""
    return inventory.filter("kind = 'file' AND file_type = 'archive'").orderBy("relative_path")


def implementation_digest(*modules: object) -> str:
    """SHA-256 over the sources of modules: the version part of a cache key."""
    digest = hashlib.sha256()
    for module in modules:
        with open(module.__file__, "rb") as f:
            digest.update(hashlib.sha256(f.read()).digest())
    return digest.hexdigest()
