"""Nucleotide sequence functions: all expressions but bit packing, which is an Arrow UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# Symbols in token order (ids from 2; 0 pads, 1 masks) and their complements.
SYMBOLS = "ACGTNRYSWKMBDHV"
COMPLEMENTS = "TGCANYRSWMKVHDB"
PAD, MASK = 0, 1
AMBIGUOUS = "RYSWKMBDHV"


def ascii_upper(value: Column) -> Column:
    """a-z as A-Z; other letters stay, so lengths never change."""
    return F.translate(value, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def reverse_complement(sequence: Column) -> Column:
    """Upper-case reverse complement; other symbols stay."""
    return F.reverse(F.translate(ascii_upper(sequence), SYMBOLS, COMPLEMENTS))


def symbol_count(sequence: Column, symbols: str) -> Column:
    """How many characters of ``sequence`` are in ``symbols``."""
    return (F.length(sequence) - F.length(F.translate(sequence, symbols, ""))).cast("bigint")


def tokens(sequence: Column) -> Column:
    """Token ids; unknown symbols become N."""
    place = F.lit(SYMBOLS)
    return F.transform(F.filter(F.split(ascii_upper(sequence), ""), lambda c: c != ""), lambda c: F.when(F.instr(place, c) > 0, F.instr(place, c) + 1).otherwise(F.lit(6)))


def token_arrays(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all sequences, where each begins, one entry more): what ``tokens`` gives, by a table of bytes."""
    table = np.full(256, 6, np.int64)
    for i, c in enumerate(SYMBOLS):
        table[[ord(c), ord(c.lower())]] = i + 2
    values = values.fill_null("").cast(pa.large_string())
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    first = (data & 0xC0) != 0x80  # a character of several bytes is one unknown symbol
    return table[data[first]], np.append(0, np.cumsum(first))[at - at[0]]


def reverse_complement_tokens(ids: Column) -> Column:
    """Token ids of the reverse complement; padding and mask stay."""
    table = F.array(*(F.lit(i) for i in [PAD, MASK, *(SYMBOLS.index(c) + 2 for c in COMPLEMENTS)]))
    return F.transform(F.reverse(ids), lambda i: F.element_at(table, i.cast("int") + 1))


def normalised(sequence: Column) -> Column:
    """Upper case, with everything but A, C, G and T as N."""
    return F.regexp_replace(ascii_upper(sequence), "[^ACGT]", "N")


def orientation_digest(sequence: Column) -> Column:
    """The smaller of the digests of both strands, with the length: equal for a record and its reverse complement."""
    # Through a list of one, so that the text is normalised once.
    return F.transform(F.array(normalised(sequence)), lambda plain: F.concat(F.length(plain).cast("string"), F.lit(":"), F.least(F.sha2(plain, 256), F.sha2(reverse_complement(plain), 256))))[0]


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


@F.pandas_udf(BinaryType())
def pack(sequences: pd.Series) -> pd.Series:
    """Two bits a base, first base in the high bits, tail padded with A; other symbols as A."""
    code = np.zeros(256, np.uint8)
    for i, c in enumerate("ACGT"):
        code[[ord(c), ord(c.lower())]] = i

    def one(s: str | None) -> bytes | None:
        if s is None:
            return None
        c = code[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
        c = np.append(c, np.zeros(-len(c) % 4, np.uint8)).reshape(-1, 4)
        return (c << np.array([6, 4, 2, 0], np.uint8)).sum(1, dtype=np.uint8).tobytes()

    return sequences.map(one)


@F.pandas_udf(StringType())
def unpack(packed: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
    """Bases ``start`` to ``start + length`` of a packed sequence."""
    letters = np.frombuffer(b"ACGT", np.uint8)

    def one(data: bytes | None, at: int, n: int) -> str | None:
        if data is None:
            return None
        part = np.frombuffer(data, np.uint8)[at // 4 : -(-(at + n) // 4)]
        codes = ((part[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel()
        return letters[codes[at % 4 : at % 4 + n]].tobytes().decode()

    return pd.Series([one(*row) for row in zip(packed, start, length, strict=True)], dtype=object)
