"""Letting Spark split a hot key when an aggregate is joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splittable(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt away from ``keys``, so that a join on them shuffles both of its sides itself.

    An aggregate by the join keys would meet the other side without a shuffle between, and
    adaptive skew handling splits only partitions that a join has shuffled.  ``df`` should be
    small beside the other side (one row a key); moving it once more costs little.
    """
    return df.repartition(F.xxhash64(*keys))
