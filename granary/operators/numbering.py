"""Dense numbers over any number of rows, in the order of columns of any type.

Rows are cut into ranges at quantiles that Spark samples, so a key far from all others
moves no other row into its range, and no task sorts more than a range.  Which range a
row is in is written once; the counts of ranges then give each range its first number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.lineage import written

#: Rows that a task numbers at a time.
RANGE_ROWS = 1_000_000
#: Small tables are cut into more ranges than this asks for, so that all cores work.
LEAST_ROWS, LEAST_RANGES = 20_000, 16
#: Rows that one row becomes in one step of ``expanded``.
CHUNK = 100_000


def numbered(df: DataFrame, order: list[str], name: str, copies: str | None = None, rows: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` and its number from 0 in the ascending order of the columns ``order`` (nulls first) as column ``name``.

    A row that stands for several (column ``copies``) is numbered as the first of them.  Rows
    that tie in all of ``order`` share a range and get numbers in any order, so where ties may
    be many, count them first and pass their count.  ``rows`` is how many rows there are, where
    that is known.  An empty table gives an empty result.
    """
    kept, by = df.columns, [f"by{i}" for i in range(len(order))]
    rows = df.count() if rows is None else rows
    ranges = max(1, -(-rows // range_rows), min(LEAST_RANGES, rows // LEAST_ROWS))
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), *(F.col(f"`{c}`").alias(b) for b, c in zip(by, order, strict=True)), (F.col(f"`{copies}`") if copies else F.lit(1)).cast("long").alias("step"))
    ranged = written(packed.repartitionByRange(ranges, *by).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("range").agg(F.sum("step").alias("n"))
    first = counts.select("range", F.expr("coalesce(sum(n) over (order by range rows between unbounded preceding and 1 preceding), 0)").alias("first"))
    before = F.coalesce(F.sum("step").over(Window.partitionBy("range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("before", before).join(F.broadcast(first), "range").select("row.*", (F.col("first") + F.col("before")).alias(name))


def expanded(df: DataFrame, number: str, copies: str) -> DataFrame:
    """A row for each of the ``copies`` of a row, numbered on from ``number``; without the column ``copies``.

    A row with very many copies becomes chunks first, which are dealt to all tasks.
    """
    n, c = F.col(f"`{number}`"), F.col(f"`{copies}`")

    def each(rows: DataFrame) -> DataFrame:
        return rows.withColumn(number, F.explode(F.sequence(n, n + c - 1))).drop(copies)

    few = each(df.filter(c <= CHUNK))
    chunks = df.filter(c > CHUNK).withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), c - 1, F.lit(CHUNK).cast("long"))))
    chunks = chunks.select(*(x for x in df.columns if x not in (number, copies)), (n + F.col("__at")).alias(number), F.least(F.lit(CHUNK).cast("long"), c - F.col("__at")).alias(copies))
    many = each(chunks.repartition(F.xxhash64(number)))
    return few.unionByName(many)
