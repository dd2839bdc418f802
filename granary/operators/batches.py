"""Arrow batches of bounded size, whatever the length of their rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text, or elements of each list; 0 where null."""
    of = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length
    return pc.fill_null(of(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def bounded(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes or elements of a column, one row at least; an empty batch as it is."""
    step = np.cumsum(lengths(batch.column(column)) + 1) // most
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
    yield from (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
