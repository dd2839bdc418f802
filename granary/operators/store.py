"""A packed sequence store as tables: two bits a base in fixed blocks, contigs, and intervals that may be called.

All records of a source stand one after the other on one axis.  A block is ``BLOCK`` places of
that axis, whatever chunks or records it holds, so any range of a source is an equi-join on
(source, block): random access costs the blocks it touches, a store of any size is spread by
block, and a range that crosses borders takes as many rows as it has blocks.

Symbols other than A, C, G and T are stored as A and are outside the callable intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.sequences import COMPLEMENTS, SYMBOLS, pack
from granary.operators.intervals import merge_half_open
from granary.operators.lineage import written
from granary.operators.numbering import numbered
from granary.operators.skew import splittable

BLOCK = 1 << 16
#: Bases of the next block that stand beside a block where ranges are read: most ranges then meet one row.
REACH = 1024


def chunked(df: DataFrame, keys: list[str], symbols: str, size: int, number: str = "chunk") -> DataFrame:
    """(keys, ``number``, symbols): each sequence as rows of ``size`` symbols; an empty or null one is one empty row."""
    whole = F.coalesce(F.col(symbols), F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.length(whole), F.lit(1)), F.lit(size))
    return df.select(*keys, whole.alias("__s"), F.posexplode(starts).alias(number, "__at")).select(*keys, F.col(number).cast("long").alias(number), F.substring("__s", F.col("__at"), F.lit(size)).alias(symbols))


def placed(chunks: DataFrame, source: str, record: str, number: str, symbols: str) -> DataFrame:
    """``chunks`` with ``at``, where each begins on its source's axis, and ``record_at``, where its record does.

    Records are in order of ``record``, chunks in order of ``number``; (source, record, number)
    names one chunk.  Offsets are running sums over one narrow row a chunk, taken range by range,
    so a source of any length is summed by many tasks.
    """
    sizes = written(chunks.select(source, record, number, F.length(symbols).cast("long").alias("__n")), "sizes")
    along = written(numbered(sizes, [source, record, number], "at", "__n").drop("__n"), "along")
    first = along.groupBy(source).agg(F.min("at").alias("__first"))
    heads = along.groupBy(source, record).agg(F.min("at").alias("__head"))
    # Narrow rows are joined with each other first, so symbols are shuffled once.
    where = along.join(splittable(first, source), source).join(splittable(heads, source, record), [source, record])
    where = where.select(source, record, number, (F.col("at") - F.col("__first")).alias("at"), (F.col("__head") - F.col("__first")).alias("record_at"))
    return chunks.join(where, [source, record, number])


def axis(sizes: DataFrame, source: str, record: str, n: str) -> DataFrame:
    """(source, record, at): where each record begins on its source's axis, in order of ``record``; one narrow row each, no symbols."""
    narrow = written(sizes.select(source, record, F.col(n).cast("long").alias("__n")), "sizes")
    along = written(numbered(narrow, [source, record], "at", "__n").drop("__n"), "along")
    first = along.groupBy(source).agg(F.min("at").alias("__first"))
    return along.join(splittable(first, source), source).select(source, record, (F.col("at") - F.col("__first")).alias("at"))


def contigs(placed_chunks: DataFrame, source: str, record: str, symbols: str, *more: str) -> DataFrame:
    """(source, record, ``more``, start, length) of each record on its source's axis."""
    return placed_chunks.groupBy(source, record, *more).agg(F.min("record_at").alias("start"), F.sum(F.length(symbols)).cast("long").alias("length"))


def blocks(placed_chunks: DataFrame, source: str, symbols: str, block: int = BLOCK) -> DataFrame:
    """(source, block, length, packed): the store; all blocks but a source's last one have ``block`` bases."""
    n = F.length(symbols).cast("long")
    numbers = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + n - 1) / block))
    cut = placed_chunks.filter(n > 0).select(source, "at", F.col(symbols).alias("__s"), F.explode(numbers).alias("block"))
    low = F.greatest(F.col("block") * block, F.col("at"))
    piece = F.substring("__s", (low - F.col("at") + 1).cast("int"), (F.col("block") * block + block - low).cast("int"))
    pieces = cut.select(source, "block", low.alias("low"), piece.alias("s"))
    # As many pieces as chunks meet in a block: a block's bases at most.
    joined = pieces.groupBy(source, "block").agg(F.array_sort(F.collect_list(F.struct("low", "s"))).alias("p"))
    whole = joined.select(source, "block", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("s"))
    return whole.select(source, "block", F.length("s").alias("length"), pack("s").alias("packed"))


def packed_blocks(records: DataFrame, source: str, block: int = BLOCK) -> DataFrame:
    """The store, as of ``blocks``, from whole records (source, at, n, packed) of ``n`` symbols, four to a byte; symbols move packed."""
    n, at, edge = F.col("n"), F.col("at"), F.col("block") * block
    cut = records.filter(n > 0).select(source, "at", "n", "packed", F.explode(F.sequence(F.floor(at / block), F.floor((at + n - 1) / block))).alias("block"))
    low, high = F.greatest(edge, at), F.least(edge + block, at + n)
    skip = (low - at) % 4
    piece = F.substring("packed", ((low - at - skip) / 4 + 1).cast("int"), F.ceil((high - low + skip) / 4).cast("int"))
    pieces = cut.select(source, "block", F.struct(low.alias("low"), skip.cast("int").alias("skip"), (high - low).cast("int").alias("n"), piece.alias("b")).alias("p"))
    joined = pieces.groupBy(source, "block").agg(F.array_sort(F.collect_list("p")).alias("p"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, _BLOCKS) for whole in batches for i in range(0, max(whole.num_rows, 1), _BLOCKS)):
            ends, flat = batch.column(2).offsets.to_numpy(), batch.column(2).flatten()
            skip, many = (flat.field(c).to_numpy().astype(np.int64) for c in ("skip", "n"))
            data = flat.field("b").cast(pa.large_binary())
            at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
            raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
            codes = ((raw[:, None] >> _SHIFTS) & 3).ravel()
            begin = 4 * (at[:-1] - at[0]) + skip
            before = np.append(0, np.cumsum(many))
            codes = codes[np.repeat(begin - before[:-1], many) + np.arange(before[-1])]
            length = np.diff(before[ends - ends[0]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(length.astype(np.int32)), packed_rows(codes, length)], [source, "block", "length", "packed"])

    return joined.mapInArrow(whole, T.StructType([joined.schema[source], joined.schema["block"], T.StructField("length", T.IntegerType()), T.StructField("packed", T.BinaryType())]))


def packed_rows(codes: np.ndarray, length: np.ndarray) -> pa.Array:
    """Rows of ``length`` codes each, four to a byte, first in the high bits, each row's tail padded with 0."""
    size = -(-length // 4)
    ends, before = np.append(0, np.cumsum(size)), np.append(0, np.cumsum(length))
    padded = np.zeros(4 * ends[-1], np.uint8)
    padded[np.repeat(4 * ends[:-1] - before[:-1], length) + np.arange(before[-1])] = codes
    packed = (padded.reshape(-1, 4) << _SHIFTS).sum(1, dtype=np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)]).cast(pa.binary())


def callable_intervals(placed_chunks: DataFrame, source: str, record: str, symbols: str) -> DataFrame:
    """(source, record, start, end) of maximal runs of A, C, G and T on the source's axis, half open; none spans two records."""
    out = T.StructType([*(placed_chunks.schema[c] for c in (source, record)), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    good = np.zeros(256, bool)
    good[[ord(c) for c in "ACGTacgt"]] = True

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, (at, s) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                on = np.concatenate([[False], good[np.frombuffer(s.encode("ascii", "replace"), np.uint8)], [False]])
                edges = np.flatnonzero(on[1:] != on[:-1])
                starts.append(at + edges[::2])
                ends.append(at + edges[1::2])
                rows.append(np.full(len(edges) // 2, i))
            joined = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (rows, starts, ends)]
            of = pa.array(joined[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(joined[1]), pa.array(joined[2])], [source, record, "start", "end"])

    found = placed_chunks.select(source, record, "at", symbols).mapInArrow(runs, out)
    return merge_half_open(found, [source, record], "start", "end")  # runs that meet at a border between chunks are one


_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_SHIFTS = np.array([6, 4, 2, 0], np.uint8)
#: Blocks that are put together at once.
_BLOCKS = 64
#: The four bases of each byte.
_FOUR = _LETTERS[(np.arange(256)[:, None] >> _SHIFTS) & 3]


def _read(data: bytes, a: int, n: int) -> bytes:
    return _FOUR[np.frombuffer(data, np.uint8, -(-(a + n) // 4) - a // 4, a // 4)].tobytes()[a % 4 : a % 4 + n]


def _bases(packed: pa.Array, low: np.ndarray, many: np.ndarray, held: np.ndarray, following: pa.Array) -> pa.Array:
    """Bases ``low`` to ``low + many`` of each packed block of ``held`` bases and what follows it; null where the block is."""
    out = []
    for data, a, n, most, more in zip(packed, low.tolist(), many.tolist(), held.tolist(), following, strict=True):
        if not data.is_valid:
            out.append(None)
        elif a + n <= most:
            out.append(_read(data.as_buffer(), a, n))
        else:
            own = max(most - a, 0)
            out.append((_read(data.as_buffer(), a, own) if own else b"") + _read(more.as_buffer(), max(a - most, 0), n - own))
    return pa.array(out, pa.binary()).cast(pa.string())


def decode(store: DataFrame, ranges: DataFrame, source: str, start: str, length: str, name: str = "bases", block: int = BLOCK) -> DataFrame:
    """``ranges`` with the bases of each; ``store`` is that of ``blocks``.

    A range within one block, or that ends in the first ``REACH`` bases of the next, meets them with
    all its columns, and its bases are read in that same task, so they are never shuffled.  A longer
    one that crosses borders becomes a row for each block that it touches, whose pieces are joined;
    equal ones of these are decoded once.  Only what a range
    takes of a block is unpacked.  A range that leaves its source, or whose source is not there,
    has null bases.
    """
    a, n = F.col(start).cast("long"), F.col(length).cast("long")
    reach = min(block, REACH)
    first = F.floor(a / block)
    low = a - first * block
    sound, near = (a >= 0) & (n > 0), low + n <= block + reach
    unsound = ranges.filter(~F.coalesce(sound, F.lit(False))).select(*ranges.columns, F.lit(None).cast("string").alias(name))
    held = store.select(F.col(source).alias("__of"), F.col("block").alias("__at"), F.col("length").alias("__held"), "packed")

    heads = store.select(F.col(source).alias("__next_of"), (F.col("block") - 1).alias("__next_at"), F.least("length", F.lit(reach)).alias("__more"), F.substring("packed", 1, -(-reach // 4)).alias("__next"))
    pairs = heads.join(held, (F.col("__of") == F.col("__next_of")) & (F.col("__at") == F.col("__next_at")), "right").drop("__next_of", "__next_at")
    # Ranges bring no columns but their own, as very many may be read from few blocks.
    inner = ranges.filter(sound & near).join(pairs, (F.col(source) == F.col("__of")) & (first == F.col("__at")), "left")
    fits = low + n <= F.col("__held") + F.coalesce("__more", F.lit(0))
    inner = inner.select(*ranges.columns, low.alias("__low"), n.alias("__n"), F.when(fits, F.col("packed")).alias("packed"), F.coalesce("__held", F.lit(0)).cast("long").alias("__held"), "__next")
    whole = _unpacked(inner, ranges.columns, name)

    crossing = ranges.filter(sound & ~near).withColumns({"__a": a, "__n": n, "__block": first, "__last": F.floor((a + n - 1) / block)})
    wanted = crossing.select(F.col(source).alias("__source"), "__a", "__n", "__block", "__last").distinct()
    each = wanted.withColumn("__block", F.explode(F.sequence("__block", "__last")))
    low = F.greatest(F.col("__a") - F.col("__block") * block, F.lit(0))
    many = F.least(F.col("__a") + F.col("__n") - F.col("__block") * block, F.col("__held").cast("long")) - low
    met = each.join(held, (F.col("__source") == F.col("__of")) & (F.col("__block") == F.col("__at")))
    met = met.select("__source", "__a", "__n", "__block", low.alias("__low"), many.alias("__many"), "packed", F.col("__held").cast("long").alias("__held"), F.lit(None).cast("binary").alias("__next")).filter("__many > 0")
    pieces = _unpacked(met, ["__source", "__a", "__n", "__block"], "s").groupBy("__source", "__a", "__n").agg(F.array_sort(F.collect_list(F.struct("__block", "s"))).alias("p"))
    joined = pieces.select("__source", F.col("__a").alias("__from"), F.col("__n").alias("__size"), F.array_join(F.transform("p", lambda x: x["s"]), "").alias(name)).filter(F.length(name) == F.col("__size"))
    on = (F.col(source) == F.col("__source")) & (F.col("__a") == F.col("__from")) & (F.col("__n") == F.col("__size"))
    crossing = crossing.join(splittable(joined, "__source", "__from", "__size"), on, "left").select(*ranges.columns, name)
    return whole.unionAll(crossing).unionAll(unsound)


def _unpacked(met: DataFrame, kept: list[str], name: str) -> DataFrame:
    """Columns ``kept`` of ``met``, whose last five say where to read, how many, in which block, of how many bases, and what follows it; and the bases there."""
    out = T.StructType([*(met.schema[c] for c in kept), T.StructField(name, T.StringType())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, many, packed, held, following = batch.columns[len(kept) :]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], _bases(packed, low.to_numpy(), many.to_numpy(), held.to_numpy(), following)], [*kept, name])

    return met.mapInArrow(unpack, out)


def strand(bases: Column, reverse: Column) -> Column:
    """``bases``, or their reverse complement."""
    return F.when(reverse, F.reverse(F.translate(bases, SYMBOLS, COMPLEMENTS))).otherwise(bases)
