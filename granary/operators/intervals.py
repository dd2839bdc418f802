"""Interval algebra on long tables (key columns, start, end), by windows and equi-joins.

Every operator partitions by the key columns; a key's intervals are sorted in one task,
so keys should be records (contigs, parts), not whole collections.  Where a key may be
very large, cut it by position first and merge twice: merging is associative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.sequences import ascii_upper


def _islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("__open", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    return opened.withColumn("__island", F.sum("__open").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _merged(df: DataFrame, keys: list[str], start: str, end: str, gap: int) -> DataFrame:
    """Unions of intervals by one sort: the last row of an island has its ends, so nothing is grouped.

    Starts ascend, so the latest row that opens an island has the largest start of those that do;
    all before an island end before it, so the largest end up to its last row is its own.
    """
    order = Window.partitionBy(*keys).orderBy(start, end)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.select(*keys, start, end, (reach.isNull() | (F.col(start) > reach + gap)).alias("__open"))
    low, high = F.max(F.when(F.col("__open"), F.col(start))).over(so_far), F.max(end).over(so_far)
    ended = opened.select(*keys, low.alias("__low"), high.alias("__high"), F.coalesce(F.lead("__open").over(order), F.lit(True)).alias("__last"))
    return ended.filter("__last").select(*keys, F.col("__low").alias(start), F.col("__high").alias(end))


def merge_half_open(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Unions of half-open intervals; touching ones join, empty ones go, reversed ones are an error."""
    sound = df.select(*keys, F.when(F.col(end) < F.col(start), F.raise_error(F.lit("reversed interval"))).otherwise(F.col(start)).cast("bigint").alias(start), F.col(end).cast("bigint").alias(end))
    return _merged(sound.filter(F.col(end) > F.col(start)), keys, start, end, 0)


def merge_inclusive(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Unions of closed intervals; adjacent ones join, reversed ends are swapped."""
    ordered = df.select(*keys, F.least(start, end).cast("bigint").alias(start), F.greatest(start, end).cast("bigint").alias(end))
    return _merged(ordered, keys, start, end, 1)


def merged_bases(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Positions that closed intervals cover, by key."""
    return merge_inclusive(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start) + 1).cast("bigint").alias("bases"))


def merge_sources(df: DataFrame, keys: list[str], source: str, start: str = "start", end: str = "end") -> DataFrame:
    """Half-open unions with the sorted sources that contributed to each."""
    merged = _islands(df.filter(F.col(end) > F.col(start)), keys, start, end, 0)
    return merged.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.array_sort(F.collect_set(source)).alias("sources")).drop("__island")


def subtract(df: DataFrame, masks: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """What of the intervals no mask covers, both half-open and merged first.

    One sweep instead of an overlap join: the borders of both sides are sorted together
    and each stretch between borders is kept where an interval is open and no mask is.
    """
    sides = []
    for side, table in ((1, df), (0, masks)):
        merged = merge_half_open(table, keys, start, end)
        mine, other = F.lit(side), F.lit(1 - side)
        sides.append(merged.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), mine.alias("di"), other.alias("dm")), F.struct(F.col(end).alias("at"), (-mine).alias("di"), (-other).alias("dm")))).alias("b")).select(*keys, "b.*"))
    borders = sides[0].unionByName(sides[1]).groupBy(*keys, "at").agg(F.sum("di").alias("di"), F.sum("dm").alias("dm"))
    order = Window.partitionBy(*keys).orderBy("at")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = borders.select(*keys, F.col("at").alias(start), F.lead("at").over(order).alias(end), F.sum("di").over(running).alias("inside"), F.sum("dm").over(running).alias("masked"))
    return merge_half_open(swept.filter((F.col("inside") > 0) & (F.col("masked") == 0)), keys, start, end)


def localise(intervals: DataFrame, records: DataFrame, keys: list[str], index: str = "record_index") -> DataFrame:
    """Global (start, length) intervals as merged record-local (start, end); leaving the record is an error."""
    joined = intervals.join(records.select(*keys, index, F.col("offset").alias("__offset"), F.col("length").alias("__size")), [*keys, index])
    low = F.col("start") - F.col("__offset")
    bad = (low < 0) | (low + F.col("length") > F.col("__size"))
    local = joined.select(*keys, index, F.when(bad, F.raise_error(F.lit("interval leaves its record"))).otherwise(low).cast("bigint").alias("start"), (low + F.col("length")).alias("end"))
    return merge_half_open(local, [*keys, index])


def running_offsets(records: DataFrame, keys: list[str], order: list[str], length: str = "length") -> DataFrame:
    """``records`` with the summed length of the records before each as ``offset``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("bigint"))


def capacity(df: DataFrame, keys: list[str], contexts: list[int], start: str = "start", end: str = "end", overlapping: bool = False) -> DataFrame:
    """Windows that fit the intervals, by key and context: side by side, or at every start."""
    if any(c < 1 for c in contexts):
        raise ValueError("contexts must be positive")
    size = F.col(end) - F.col(start)
    c = F.col("context")
    fit = F.greatest(size - c + 1, F.lit(0)) if overlapping else F.floor(size / c)
    each = df.select(*keys, start, end, F.explode(F.array(*(F.lit(int(x)).cast("bigint") for x in contexts))).alias("context"))
    return each.groupBy(*keys, "context").agg(F.sum(fit).cast("bigint").alias("windows"))


def contained(inner: DataFrame, outer: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Rows of ``inner`` with a flag ``inside``: one interval of ``outer`` (merged first) holds it all.

    The only candidate is the last outer interval that starts no later, found by a
    running maximum over both sides sorted together, not by a range join.
    """
    merged = merge_half_open(outer, keys, start, end)
    left = inner.withColumn("__row", F.struct(*inner.columns)).select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), F.lit(1).alias("__side"), "__row")
    right = merged.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"))
    order = Window.partitionBy(*keys).orderBy("__s", "__side").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("__side") == 0, F.col("__e"))).over(order)
    return left.unionByName(right).withColumn("__reach", reach).filter("__side = 1").select("__row.*", F.coalesce(F.col("__e") <= F.col("__reach"), F.lit(False)).alias("inside"))


def overlap_violations(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that begin before one that is sorted earlier has ended."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("previous_end", before).filter(F.col(start) < F.col("previous_end"))


def chunks(df: DataFrame, text: str, size: int, least: int, symbols: str, share: float) -> DataFrame:
    """Fixed-length pieces of a text that are long enough and rich enough in ``symbols``, upper-cased."""
    if size < 1 or least < 1:
        raise ValueError("chunk and minimum lengths must be positive")
    cut = df.filter(F.length(text) > 0).select("*", F.explode(F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).alias("chunk_start"))
    cut = cut.withColumn("chunk", ascii_upper(F.substring(F.col(text), F.col("chunk_start") + 1, F.lit(size))))
    good = F.length("chunk") - F.length(F.translate("chunk", symbols, ""))
    cut = cut.filter((F.length("chunk") >= least) & (good / F.length("chunk") >= share))
    return cut.withColumn("chunk_end", F.col("chunk_start") + F.length("chunk")).withColumns({c: F.col(c).cast("bigint") for c in ("chunk_start", "chunk_end")})


def callable_runs(df: DataFrame, keys: list[str], sequence: str, symbols: str = "ACGT", offset: Column | None = None) -> DataFrame:
    """Runs of the given symbols (any case) in each sequence as (start, end)."""
    runs = F.regexp_extract_all(ascii_upper(F.col(sequence)), F.lit(f"([{symbols}]+|[^{symbols}]+)"), F.lit(1))
    placed = df.select(*keys, (F.lit(0) if offset is None else offset).alias("__at"), F.posexplode(runs).alias("__i", "__run"))
    w = Window.partitionBy(*keys).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("__at") + F.coalesce(F.sum(F.length("__run")).over(w), F.lit(0))
    found = placed.select(*keys, begin.cast("bigint").alias("start"), (begin + F.length("__run")).cast("bigint").alias("end"), "__run")
    return found.filter(F.col("__run").rlike(f"^[{symbols}]")).drop("__run")
