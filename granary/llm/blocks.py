"""Exchange of corpus-wide facts between blocks of documents and ranges of hashes.

Operators that need a fact about every n-gram (or string anchor) of the corpus, at
every place where it occurs, use one pattern.  Documents are dealt into blocks of
bounded size.  Each block sends its *distinct* 64-bit hashes, sorted, delta-coded and
compressed, one row for each range of hash values.  Each range merges what all blocks
sent, and sends back to a block only what the block could not know by itself.  Blocks
then work on whole texts again with a table as small as the block.

A hot key costs one entry per block and a range holds about as many entries as a block, so
the memory of a task is that of a block.  Rows of an exchange are blocks times ranges, each
of a block's bytes over the ranges: at 8 MB a block that is 40 million rows at 30 GB; for
very large corpora blocks must grow with the memory of executors.  The deal of documents is
one shuffle of compressed texts, which Spark reuses for every later visit in the same query.
Equal rows are dealt by where they are read as well: those of ``NEIGHBOURS`` input partitions
share a block, so a row that is repeated very often lands in as many blocks as its partitions
fill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes that a row costs beside its text.
ROW_BYTES = 100
#: Fewer blocks than this would leave executors idle on small inputs.
LEAST_BLOCKS = 8


#: Neighbouring input partitions whose equal rows share a block.
NEIGHBOURS = 64

_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _sealed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_batch(rows)
    return _pack.compress(sink.getvalue())


def _unsealed(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(_unpack.decompress(data)).read_all()


def deal(df: DataFrame, key: str, text: str, block_bytes: int, **more: Column) -> tuple[DataFrame, int, int, Callable[[pa.Table], pa.Table]]:
    """Rows dealt by block, the number of blocks of about ``block_bytes``, the bytes of all, and how a block's rows are read.

    Dealt rows are (block, payload): a compressed table of the block's rows in one batch.  The
    function returned last gives a block's (key, text, ``more``) in an order that depends on
    nothing but their values; null texts are empty.
    """
    plain = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(c.alias(n) for n, c in more.items()))
    size = int(df.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(ROW_BYTES))).first()[0] or 0)
    blocks = max(LEAST_BLOCKS, -(-size // block_bytes))
    kinds = to_arrow_schema(plain.schema)
    block = F.pmod(F.xxhash64("key", "text", F.floor(F.spark_partition_id() / NEIGHBOURS)), F.lit(blocks)).cast("int")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = batch.column(0).to_numpy()
            by = np.argsort(to, kind="stable")
            rows = batch.select(batch.schema.names[1:]).take(pa.array(by))
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(to[by]) != 0)), len(to)) if len(to) else np.zeros(1, np.int64)
            payloads = [_sealed(rows.slice(a, b - a)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(to[by][cuts[:-1]], pa.int32()), pa.array(payloads, pa.binary())], ["block", "payload"])

    def opened(table: pa.Table) -> pa.Table:
        parts = [_unsealed(x.as_py()) for x in table["payload"]]
        rows = pa.concat_tables([p.cast(kinds) for p in parts]) if parts else kinds.empty_table()
        order = [("key", "ascending"), ("text", "ascending")]
        return rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))

    dealt = plain.select(block.alias("block"), *plain.columns).mapInArrow(close, "block int, payload binary")
    return dealt.repartitionById(blocks, F.col("block")), blocks, size, opened


def to_owner(df: DataFrame, owner: str, n: int) -> DataFrame:
    """``df`` with each of ``n`` owners (blocks or ranges) in a task of its own, so that no two meet by chance of a hash."""
    return df.repartitionById(n, F.col(owner))


def _planes(values: np.ndarray) -> bytes:
    return _pack.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _values(data: bytes, dtype: type) -> np.ndarray:
    flat = np.frombuffer(_unpack.decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed differences."""
    return _planes(np.diff(values.astype(np.uint64), prepend=np.uint64(0))) if len(values) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    """The values of ``pack_sorted``."""
    return np.cumsum(_values(data, np.uint64), dtype=np.uint64) if data else np.zeros(0, np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Any 64-bit integers, compressed by byte plane."""
    return _planes(values.astype(np.int64)) if len(values) else b""


def unpack(data: bytes) -> np.ndarray:
    """The values of ``pack``."""
    return _values(data, np.int64) if data else np.zeros(0, np.int64)


def range_cuts(values: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal ranges of hash values starts among sorted ``values`` (one entry more)."""
    edges = np.array([i * (1 << 64) // ranges for i in range(ranges)], np.uint64)
    return np.append(np.searchsorted(values, edges), len(values))


def first_of_runs(values: np.ndarray) -> np.ndarray:
    """Index of the first of each run of equal sorted values."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
