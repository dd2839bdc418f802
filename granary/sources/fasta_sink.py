"""Sequence files as a Spark sink: chunks with gapless ids, committed together.

Rows are numbered before they are written, so a task knows its ids.  Each task writes one file
under a hidden name and tells the driver its first and last id, bases and digest; a task that is
tried again writes another one, of which only the one that was told counts.  The commit checks
that the ids of all files are those from 1 to the last one, each once, renames the files and
writes the map of ids last.  An abort takes away what tasks have told.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from granary.functions.sequences import symbol_count
from granary.operators.numbering import numbered
from granary.plans.policy import CHUNK_LENGTH, LEAST_ACGT_SHARE, LEAST_CHUNK
from granary.sources.streamed import _place

#: Bases on a line.
WIDTH = 80


@dataclass
class _Written(WriterCommitMessage):
    file: str
    first: int
    last: int
    rows: int
    bases: int
    sha256: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return _place(self.path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, folder = self._folder()
        name, digest = f".{uuid.uuid4().hex}.tmp", hashlib.sha256()
        first = last = rows = bases = 0
        store.create_dir(folder)
        with store.open_output_stream(posixpath.join(folder, name)) as out:
            for r in iterator:
                lines = "\n".join(r["symbols"][i : i + WIDTH] for i in range(0, len(r["symbols"]), WIDTH))
                text = f">{r['id']}\n{lines}\n".encode()
                out.write(text)
                digest.update(text)
                if rows and r["id"] != last + 1:
                    raise ValueError(f"id {r['id']} follows {last}")
                first, last, rows, bases = first or r["id"], r["id"], rows + 1, bases + len(r["symbols"])
        return _Written(name, first, last, rows, bases, digest.hexdigest())

    def commit(self, messages: list[_Written]) -> None:
        store, folder = self._folder()
        told = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)
        for m in (m for m in messages if m and not m.rows):
            store.delete_file(posixpath.join(folder, m.file))
        following = 1
        for m in told:
            if m.first != following or m.last - m.first + 1 != m.rows:
                self.abort(told)
                raise ValueError(f"ids {m.first} to {m.last} do not follow {following - 1}")
            following = m.last + 1
        parts = []
        for i, m in enumerate(told):
            name = f"part-{i:05d}.fa"
            store.move(posixpath.join(folder, m.file), posixpath.join(folder, name))
            parts.append({"file": name, "first": m.first, "last": m.last, "bases": m.bases, "sha256": m.sha256})
        with store.open_output_stream(posixpath.join(folder, "_CHUNKS")) as out:
            out.write(json.dumps({"chunks": following - 1, "files": parts}).encode())

    def abort(self, messages: list[_Written]) -> None:
        store, folder = self._folder()
        for m in messages:
            place = posixpath.join(folder, m.file) if m else ""
            if m and store.get_file_info(place).is_file:
                store.delete_file(place)


class SequenceFiles(DataSource):
    """``path``: a folder; rows are (id, symbols)."""

    @classmethod
    def name(cls) -> str:
        return "sequence_files"

    def schema(self) -> str:
        return "id long, symbols string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def kept_chunks(chunks: DataFrame, symbols: str, least: int = LEAST_CHUNK, share: float = LEAST_ACGT_SHARE) -> DataFrame:
    """Chunks that are long enough and in which enough symbols are known."""
    n = F.length(symbols)
    return chunks.filter((n >= least) & (symbol_count(F.upper(symbols), "ACGT") >= F.lit(share) * n))


def write_chunks(chunks: DataFrame, path: str, order: list[str], symbols: str, most: int = CHUNK_LENGTH) -> DataFrame:
    """Writes chunks as sequence files in ``order``, which must tell them apart, and returns (id, ``order``, length).

    Ids run from 1 without gaps over all files; a chunk that is longer than ``most`` is an error.
    """
    short = F.when(F.length(symbols) > most, F.raise_error(F.lit(f"chunk of more than {most} symbols"))).otherwise(F.col(symbols))
    listed = numbered(chunks.select(*order, short.alias("symbols")), order, "id").withColumn("id", F.col("id") + 1)
    spark = chunks.sparkSession
    spark.dataSource.register(SequenceFiles)
    ranges = max(1, -(-chunks.count() // 10_000))
    listed.select("id", "symbols").repartitionByRange(ranges, "id").sortWithinPartitions("id").write.format("sequence_files").mode("append").save(path)
    return listed.select("id", *order, F.length("symbols").alias("length"))
