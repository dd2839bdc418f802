"""Work lists: balanced shards, dense task numbers, tiered batches."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.numbering import numbered

#: Balancing by size is sequential; registries above this are refused.
MOST_ITEMS = 1_000_000


def lpt_shards(df: DataFrame, key: str, size: str, shards: int) -> DataFrame:
    """(key, size, shard): largest first onto the least loaded shard, ties to the smaller key and shard.

    The rule is a fold over the sorted registry.  Only keys and sizes of a registry (files,
    not records) are folded, and its length is checked before they come to the driver.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = df.select(key, size).orderBy(F.desc(size), key).limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"registry has more than {MOST_ITEMS} items; shard it by a hash of its key")
    loads = [(0, i) for i in range(shards)]
    out = []
    for r in rows:
        load, i = heapq.heappop(loads)
        out.append((r[key], r[size], i))
        heapq.heappush(loads, (load + (r[size] or 0), i))
    return df.sparkSession.createDataFrame(out, f"`{key}` {dict(df.dtypes)[key]}, `{size}` {dict(df.dtypes)[size]}, shard int")


def task_index(df: DataFrame, order: str, name: str = "task_index") -> DataFrame:
    """Numbers from 1 in the order of a column with distinct values of any type, by ranges at sampled quantiles."""
    return numbered(df, [order], name).withColumn(name, (F.col(name) + 1).cast("bigint"))


def at_task_index(df: DataFrame, index: int, name: str = "task_index") -> DataFrame:
    """The one row of a task number; none, or more than one, is an error where it is read."""
    one = df.filter(F.col(name) == index)
    found = one.agg(F.count(F.lit(1)).alias("__n")).select(F.when(F.col("__n") != 1, F.raise_error(F.concat(F.lit(f"rows with {name} {index}: "), F.col("__n").cast("string")))).otherwise(F.col("__n")).alias("__n"))
    return one.join(F.broadcast(found), F.col("__n") == 1, "right").drop("__n")  # one row on either side


def tiered_batch(df: DataFrame, tier: Column, order: list[Column], limits: dict[int, int]) -> DataFrame:
    """The first rows of the smallest tier that has any; ``limits`` has the batch size of each tier."""
    marked = df.withColumn("tier", tier)
    low = marked.agg(F.min("tier")).first()[0]
    return marked.filter(F.col("tier") == F.lit(low)).orderBy(*order).limit(limits.get(low, 0)) if low is not None else marked.limit(0)


def capped_retries(missing: DataFrame, attempts: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Missing keys that have been tried fewer than ``most`` times."""
    tried = attempts.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"))
    return missing.join(tried, key, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0))).filter(F.col("attempts") < most)
