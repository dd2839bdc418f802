"""Substrings of sequences that are stored as many rows.

A chunk needs the first ``size - 1`` symbols of what follows it, so these heads, and nothing
else, are sent to the chunks before it: an equi-join on record and chunk number, which spreads
a record of any length over all tasks.  Where chunks are shorter than that, heads go back as
many chunks as it takes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.similarity import canonical_kmers, scaled_sketch

#: Bases of a k-mer that a 64-bit number holds.
WORD = 32
#: K-mers that are hashed at once.
AT_ONCE = 1 << 15
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[[ord(_c), ord(_c.lower())]] = _i


def with_following(chunks: DataFrame, record: list[str], number: str, symbols: str, size: int, name: str = "window") -> DataFrame:
    """``chunks`` with column ``name``: a chunk's symbols and the ``size - 1`` symbols that follow it in its record.

    Chunks of a record are numbered from 0 without gaps.  Windows hold each substring of
    ``size`` symbols that starts in the chunk, and no other.
    """
    need = size - 1
    length = F.length(symbols)
    last = chunks.groupBy(*record).agg(F.max(number).alias("__last"))
    shortest = chunks.join(last, record).filter(F.col(number) < F.col("__last")).agg(F.min(length)).first()[0]
    hops = 0 if shortest is None or not need else -(-need // max(1, shortest))
    if not hops:
        return chunks.withColumn(name, F.col(symbols))
    back = F.explode(F.sequence(F.lit(1), F.lit(hops))).alias("__hop")
    heads = chunks.filter(F.col(number) > 0).select(*record, number, F.substring(symbols, 1, need).alias("__head"), back)
    heads = heads.withColumn(number, F.col(number) - F.col("__hop")).filter(F.col(number) >= 0)
    # One row a hop and chunk, at most: the list is as long as the number of hops.
    tails = heads.groupBy(*record, number).agg(F.array_sort(F.collect_list(F.struct("__hop", "__head"))).alias("__heads"))
    tail = F.substring(F.array_join(F.transform("__heads", lambda h: h["__head"]), ""), 1, need)
    tails = tails.select(*record, number, tail.alias("__tail"))
    return chunks.join(tails, [*record, number], "left").withColumn(name, F.concat(F.col(symbols), F.coalesce("__tail", F.lit("")))).drop("__tail")


def canonical_codes(symbols: bytes, size: int) -> np.ndarray:
    """Distinct canonical k-mers of at most ``WORD`` symbols as numbers, two bits a base, in the order of their texts."""
    return np.unique(_codes(symbols, size))


def _codes(symbols: bytes, size: int) -> np.ndarray:
    """Canonical k-mers at each place, repeats included; words of ``size`` bases are put together from words of powers of two."""
    code = _CODE[np.frombuffer(symbols, np.uint8)]
    n = len(code) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    forward = (code & 3).astype(np.uint64)
    back = np.uint64(3) - forward
    words, held, width = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)], 0, 1
    while True:
        if size & width:
            words[0] = (words[0] << np.uint64(2 * width)) | forward[held : held + n]
            words[1] |= back[held : held + n] << np.uint64(2 * held)
            held += width
        if held == size:
            break
        forward = (forward[:-width] << np.uint64(2 * width)) | forward[width:]
        back = back[:-width] | (back[width:] << np.uint64(2 * width))
        width *= 2
    unknown = np.append(0, np.cumsum(code > 3))
    return np.minimum(*words)[unknown[size:] == unknown[:-size]]


_MD5_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_MD5_ADDS = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def md5_heads(texts: np.ndarray) -> np.ndarray:
    """The first 60 bits of the MD5 of each row of bytes; rows are of one length, of 55 at most, so each is one MD5 block."""
    n, size = texts.shape
    block = np.zeros((n, 64), np.uint8)
    block[:, :size], block[:, size], block[:, 56], block[:, 57] = texts, 0x80, 8 * size & 255, 8 * size >> 8
    m = np.ascontiguousarray(block.view("<u4").T)
    fixed = [None if 4 * g <= size else np.uint32(8 * size if g == 14 else 0) for g in range(16)]  # words without a byte of the text
    a, b, c, d = (np.full(n, x, np.uint32) for x in _MD5_START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
        else:
            g = 7 * i % 16
            np.invert(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
        np.add(f, a, f)
        if fixed[g] is None:
            np.add(f, m[g], f), np.add(f, _MD5_ADDS[i], f)
        else:
            np.add(f, np.uint32((int(_MD5_ADDS[i]) + int(fixed[g])) & 0xFFFFFFFF), f)
        turn = _MD5_TURNS[i // 16, i % 4]
        np.left_shift(f, turn, t), np.right_shift(f, np.uint32(32) - turn, f), np.bitwise_or(f, t, f), np.add(f, b, f)
        a, b, c, d, f = d, f, b, c, a  # the array of a is free now
    heads = ((a + _MD5_START[0]).byteswap().astype(np.uint64) << np.uint64(32)) | (b + _MD5_START[1]).byteswap()
    return heads >> np.uint64(4)


def _window_hashes(windows: DataFrame, keys: list[str], size: int, scale: int) -> DataFrame:
    """(keys, h): hashes of the scaled sketch of each window."""
    most = np.uint64((1 << 60) // scale)
    letters = np.frombuffer(b"ACGT", np.uint8)
    fours = letters[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3]  # the bases of a byte
    schema = T.StructType([*(windows.schema[k] for k in keys), T.StructField("h", T.LongType())])

    def hashed(rows: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(codes), AT_ONCE):
            aligned = codes[at : at + AT_ONCE] << np.uint64(2 * (WORD - size))
            h = md5_heads(fours[aligned.byteswap().view(np.uint8)].reshape(-1, WORD)[:, :size])
            on = h < most
            yield rows[at : at + AT_ONCE][on], h[on].astype(np.int64)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, codes, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], [], 0
            for i, value in enumerate(batch.column(len(keys))):
                codes.append((i, _codes(value.as_py().encode("ascii", "replace"), size)))
                held += len(codes[-1][1])
                if held >= AT_ONCE or i == len(batch) - 1:  # short windows are hashed together
                    out += hashed(np.concatenate([np.full(len(c), row) for row, c in codes]), np.concatenate([c for _, c in codes]))
                    codes, held = [], 0
            rows, hashes = (np.concatenate([o[f] for o in out]) for f in range(2))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[: len(keys)]), pa.array(hashes)], [*keys, "h"])

    return windows.select(*keys, "__window").mapInArrow(apply, schema)


def chunk_sketches(chunks: DataFrame, keys: list[str], record: list[str], number: str, symbols: str, size: int, scale: int) -> DataFrame:
    """(keys, hashes): the scaled sketch of all records of each key, ascending, whatever the length of chunks.

    No substring spans two records, or has a symbol that is unknown.
    """
    windows = with_following(chunks.select(*dict.fromkeys([*keys, *record, number, symbols])), record, number, symbols, size, "__window")
    if size > WORD:
        each = windows.select(*keys, F.explode(scaled_sketch(canonical_kmers(F.col("__window"), size), scale)).alias("h"))
    else:
        each = _window_hashes(windows, keys, size, scale)
    each = each.distinct()
    found = each.groupBy(*keys).agg(F.array_sort(F.collect_list("h")).alias("hashes"))
    return chunks.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("hashes", F.array().cast("array<bigint>")).alias("hashes"))
