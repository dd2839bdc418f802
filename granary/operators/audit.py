"""Audit aggregation: registry, results and failures into one status table; contracts as tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.gates import best
from granary.operators.skew import splittable


def audit_status(registry: DataFrame, results: DataFrame, failures: DataFrame, key: str, exclusive: bool = False) -> DataFrame:
    """``registry`` with ``status``: PASS with a result, FAIL with a failure only, else MISSING.

    ``exclusive`` makes it an error that one key has both.
    """
    passed = results.select(key).distinct().withColumn("__pass", F.lit(True))
    failed = failures.select(key).distinct().withColumn("__fail", F.lit(True))
    joined = registry.join(passed, key, "left").join(failed, key, "left")
    status = F.when(F.col("__pass"), "PASS").when(F.col("__fail"), "FAIL").otherwise("MISSING")
    if exclusive:
        status = F.when(F.col("__pass") & F.col("__fail"), F.raise_error(F.lit("both passed and failed"))).otherwise(status)
    return joined.withColumn("status", status).drop("__pass", "__fail")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given; ties must be broken by it."""
    return best(df, keys, order)


def missing_and_extra(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, side): keys expected but not there, and there but not expected; a null key equals none.

    One aggregate over both tables: a task holds each of its keys once, with two flags, and sorts none.
    """
    both = expected.select(key, F.lit(True).alias("__in"), F.lit(False).alias("__out")).unionAll(observed.select(key, F.lit(False), F.lit(True)))
    seen = both.groupBy(key).agg(F.bool_or("__in").alias("__in"), F.bool_or("__out").alias("__out"))
    alone = seen.filter((F.col("__in") != F.col("__out")) | F.col(key).isNull())
    sides = F.array_compact(F.array(F.when(F.col("__in"), "missing"), F.when(F.col("__out"), "extra")))
    return alone.select(key, F.explode(sides).alias("side"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (with multiplicity) that only one of two tables has, with the ``side`` that has them."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def exact_groups(df: DataFrame, digest: str, prefix: str, singletons: bool, passing: Column | None = None) -> DataFrame:
    """Adds ``exact_group`` and ``exact_group_size`` over equal digests of passing rows.

    Without ``singletons`` a row alone has an empty group of size 1; rows that do not pass
    have an empty group of size 0.  Sizes come from an aggregate joined back, so a digest
    with very many rows is counted before the shuffle.
    """
    good = F.lit(True) if passing is None else F.coalesce(passing, F.lit(False))
    marked = df.withColumn("__digest", F.when(good, F.col(digest)))
    sizes = marked.filter(F.col("__digest").isNotNull()).groupBy("__digest").agg(F.count(F.lit(1)).alias("__size"))
    named = F.concat(F.lit(prefix), F.substring("__digest", 1, 16))
    group = named if singletons else F.when(F.col("__size") > 1, named)
    out = marked.join(splittable(sizes, "__digest"), "__digest", "left")
    return out.withColumns({"exact_group": F.coalesce(group, F.lit("")), "exact_group_size": F.coalesce("__size", F.lit(0)).cast("bigint")}).drop("__digest", "__size")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Contract: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Contract: keys with more than one value."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("values")).filter("values > 1")


def require_empty(violations: DataFrame, what: str) -> None:
    """Raises with a few examples if a contract is violated."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {[r.asDict() for r in some]}")


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails on a left key without a partner, where the row is read."""
    joined = left.join(right.withColumn("__there", F.lit(True)), key, "left")
    sure = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no partner: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return joined.withColumn(key, sure).drop("__there")


def content_digest(df: DataFrame) -> DataFrame:
    """One row: number of rows and an order-free digest of all of them.

    Row digests are summed as numbers, so nothing is collected or sorted.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.conv(F.substring(row, i, 12), 16, 10).cast("decimal(38,0)")
    sums = F.concat_ws("-", *(F.coalesce(F.sum(part(i)), F.lit(0)).cast("string") for i in (1, 13, 25, 37)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(sums, 256).alias("digest"))


def remaining(work: DataFrame, done: DataFrame, identity: list[str]) -> DataFrame:
    """Work whose identity (key, size, time, implementation...) has no result yet."""
    return work.join(done.select(*identity).distinct(), identity, "left_anti")
