"""Hashed word features of whole texts, computed on Arrow buffers without a loop over words.

Tokens are runs of word bytes (ASCII letters and digits, ``_`` and every byte from
0x80) and runs of other visible bytes; ASCII white space and control bytes separate.
A token's hash is a polynomial over its lower-cased bytes taken from one running sum,
so cost is a few passes over the bytes whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes handled at once; bounds the working arrays of a task, which take about 40 bytes each.
PART_BYTES = 1 << 19

_RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(_RADIX, -1, 1 << 64)
_SPACE, _WORD, _MARK = 0, 1, 2
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[:33] = _SPACE
_CLASS[127] = _SPACE
_CLASS[128:] = _WORD
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz":
    _CLASS[_c] = _WORD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse, at least ``n`` of each; the largest table is kept."""
    size = max([PART_BYTES, *(k for k in _powers)])
    if n > size or not _powers:
        size = max(size, 1 << (n - 1).bit_length())
        _powers.clear()
        up, down = np.full(size, _RADIX, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = (np.cumprod(up), np.cumprod(down))
    return next(iter(_powers.values()))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def parts(texts: pa.Array, most: int = PART_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of ``texts`` of about ``most`` bytes, one text at least; nulls become empty."""
    texts = texts.fill_null("")
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each starts (one entry more than texts)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def tokens(texts: pa.Array, marks: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, index of its text), in order of appearance; without ``marks``, words only."""
    data, offsets = raw(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    change = np.empty(len(data) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    keep = kind[start] != _SPACE if marks else kind[start] == _WORD
    start, end = start[keep], end[keep]
    up, down = _power(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start])
    return h, np.searchsorted(offsets, start, "right") - 1


def pairs(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each pair of neighbouring tokens of a text, index of the text)."""
    if len(h) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left, right = h[:-1], h[1:]
    both = mix(left * np.uint64(0xA24BAED4963EE407) + right)
    inside = text[:-1] == text[1:]
    return both[inside], text[1:][inside]


def schema(df: DataFrame, keep: tuple[str, ...], more: str) -> T.StructType:
    """Schema of the columns ``keep`` of ``df``, of any name and type, and of ``more`` (DDL)."""
    return T.StructType([*(df.schema[c] for c in keep), *T.StructType.fromDDL(more).fields])


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes folded into ``buckets`` (a power of two)."""
    return (h >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)
