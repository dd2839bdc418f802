"""Entity resolution: staged imputation, propagation, aliases, pairing with fallback, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.gates import best
from granary.operators.profile import smallest
from granary.operators.skew import splittable


def unanimous(df: DataFrame, key: Column, value: str) -> DataFrame:
    """(__key, __value) for keys whose rows have exactly one value besides null and empty."""
    told = df.select(key.alias("__key"), F.col(value).alias("__value")).filter((F.col("__value") != "") & F.col("__key").isNotNull())
    return told.groupBy("__key").agg(F.min("__value").alias("__value"), F.max("__value").alias("__last")).filter("__value = __last").drop("__last")


def fill(df: DataFrame, lookup: DataFrame, key: Column, value: str, source: str, tag: str, overwrite: bool = False) -> DataFrame:
    """Sets ``value`` from a (__key, __value) lookup where it is empty (or always), and tags ``source``."""
    joined = df.withColumn("__key", key).join(splittable(lookup, "__key"), "__key", "left")
    take = F.col("__value").isNotNull()
    if not overwrite:
        take = take & (F.coalesce(F.col(value), F.lit("")) == "")
    return joined.withColumns({source: F.when(take, F.lit(tag)).otherwise(F.col(source)), value: F.when(take, F.col("__value")).otherwise(F.col(value))}).drop("__key", "__value")


def staged_imputation(df: DataFrame, value: str, passes: list[tuple[str, Column, DataFrame | None, bool]], source: str = "value_source") -> DataFrame:
    """Ordered passes, each seeing what earlier ones filled.

    A pass is (tag, key, lookup, overwrite); a lookup of None means the unanimous value of
    rows that share the key, taken from the table as it then stands.
    """
    out = df.withColumn(source, F.when(F.coalesce(F.col(value), F.lit("")) != "", F.lit("given")).otherwise(F.lit("unresolved")))
    for tag, key, lookup, overwrite in passes:
        out = fill(out, unanimous(out, key, value) if lookup is None else lookup, key, value, source, tag, overwrite)
    return out


def propagate(df: DataFrame, group: str, value: str, source: str, tag: str) -> DataFrame:
    """Fills an empty value with the group's shortest (in words), then smallest, value."""
    told = df.filter(F.coalesce(F.col(value), F.lit("")) != "")
    best = told.groupBy(F.col(group).alias("__key")).agg(F.min(F.struct(F.size(F.split(F.trim(value), r"\s+")).alias("n"), F.col(value).alias("v")))["v"].alias("__value"))
    return fill(df, best, F.col(group), value, source, tag)


def representative(df: DataFrame, key: str, group: list[str], rank: list[Column], flag: str = "is_representative") -> DataFrame:
    """Flags the first row of each group by ``rank``; ``key`` is unique.  Large groups are not sorted in one task."""
    return df.join(best(df, group, rank).select(key, F.lit(True).alias(flag)), key, "left").withColumn(flag, F.col(flag).isNotNull())


def order_of(value: Column, order: dict[str, int], default: int) -> Column:
    """Place of a value in a stated order."""
    out = F.lit(default)
    for k, v in order.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def canonical_alias(df: DataFrame, aliases: DataFrame, scope: str, key: str) -> DataFrame:
    """Replaces an alias by its canonical key within its scope.

    ``aliases`` has (scope, canonical, alias); a canonical key is its own alias.  One
    alias with two canonical keys is an error.
    """
    own = aliases.select(scope, F.col("canonical"), F.col("alias")).unionByName(aliases.select(scope, "canonical", F.col("canonical").alias("alias"))).distinct()
    table = own.groupBy(scope, "alias").agg(F.min("canonical").alias("__to"), F.max("canonical").alias("__last"))
    sure = F.when(F.col("__to") != F.col("__last"), F.raise_error(F.lit("alias with two owners"))).otherwise(F.col("__to"))
    table = table.select(scope, F.col("alias").alias(key), sure.alias("__to"))
    return df.join(table, [scope, key], "left").withColumn(key, F.coalesce("__to", key)).drop("__to")


def pair_members(right: DataFrame, key: str, fallback: str, right_id: str) -> DataFrame:
    """(pair_level, pair_key, ``right_id``): each right row under its precise key (level 1) and its wider one (level 2)."""
    levels = F.explode(F.array(F.struct(F.lit(1).alias("l"), F.col(key).cast("string").alias("k")), F.struct(F.lit(2).alias("l"), F.col(fallback).cast("string").alias("k")))).alias("p")
    return right.select(levels, right_id).select(F.col("p.l").alias("pair_level"), F.col("p.k").alias("pair_key"), right_id).filter("pair_key IS NOT NULL")


def fallback_pairing(left: DataFrame, right: DataFrame, key: tuple[str, str], fallback: tuple[str, str], right_id: str, preview: int = 20) -> DataFrame:
    """``left`` with the group of right rows it pairs with: by a precise key, else by a wider one.

    Adds pair_level (1, 2 or null), pair_key, paired_count and paired_ids, the ``preview``
    smallest ids (0: none are looked for).  All ids of a group are the rows of ``pair_members``
    with its level and key; they are not repeated for each left row, as a wide key may have any
    number of them on either side.
    """
    members = pair_members(right, key[1], fallback[1], right_id)
    groups = members.groupBy("pair_level", "pair_key").agg(F.count(F.lit(1)).alias("paired_count"))
    if preview:
        few = smallest(members, ["pair_level", "pair_key"], right_id, preview, "paired_ids")
        groups = groups.join(few, ["pair_level", "pair_key"])
    else:
        groups = groups.withColumn("paired_ids", F.array().cast(T.ArrayType(members.schema[right_id].dataType)))
    out = left
    for level, (own, _) in enumerate((key, fallback), 1):
        named = groups.filter(F.col("pair_level") == level).select(F.col("pair_key").alias(f"__k{level}"), F.struct("pair_level", "pair_key", "paired_count", "paired_ids").alias(f"__g{level}"))
        out = out.join(splittable(named, f"__k{level}"), F.col(own).cast("string") == F.col(f"__k{level}"), "left")
    out = out.withColumn("__g", F.coalesce("__g1", "__g2"))
    ids = F.coalesce("__g.paired_ids", F.array().cast(groups.schema["paired_ids"].dataType))
    return out.select(*left.columns, "__g.pair_level", "__g.pair_key", F.coalesce("__g.paired_count", F.lit(0)).cast("bigint").alias("paired_count"), ids.alias("paired_ids"))


def whole_pairing(left: DataFrame, right: DataFrame, key: tuple[str, str], fallback: tuple[str, str], left_id: str, right_id: str) -> DataFrame:
    """(side, id, pair_level, pair_key, paired_count): every pair of ``fallback_pairing`` as its group's two sides.

    A row of side "left" pairs with each row of side "right" that has its level and key, and with
    no other, so no pair is lost and none is written out: the result is one row for each left row
    and one for each right row of each group that a left row pairs with.  ``paired_count`` is how
    many rows of the other side a row has; a left row without a group has none.
    """
    found = fallback_pairing(left, right, key, fallback, right_id, 0).select(F.col(left_id).alias("id"), "pair_level", "pair_key", "paired_count")
    used = found.filter("pair_level IS NOT NULL").groupBy("pair_level", "pair_key").agg(F.count(F.lit(1)).alias("paired_count"))
    members = pair_members(right, key[1], fallback[1], right_id).join(splittable(used, "pair_level", "pair_key"), ["pair_level", "pair_key"])
    return found.select(F.lit("left").alias("side"), "*").unionByName(members.select(F.lit("right").alias("side"), F.col(right_id).alias("id"), "pair_level", "pair_key", "paired_count"))


def alias_rows(df: DataFrame, aliases: list[str], name: str = "alias") -> DataFrame:
    """One row per alias column that says something ("na" and blanks say nothing)."""
    exploded = df.withColumn(name, F.explode(F.array_distinct(F.array(*aliases))))
    return exploded.filter((F.trim(name) != "") & (F.lower(F.trim(name)) != "na"))


def union_catalog(*parts: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """UNION ALL of differently shaped tables, each through its own projection."""
    shaped = [df.select(*(c.alias(n) for n, c in columns.items())) for df, columns in parts]
    out = shaped[0]
    for df in shaped[1:]:
        out = out.unionByName(df)
    return out


def longest_fields(df: DataFrame, key: Column, order: str, longest: list[str], unions: list[str]) -> DataFrame:
    """One row per key: the longest text of each field (the first of equals), set unions of array fields."""
    picks = [F.max_by(F.col(c), F.struct(F.length(F.coalesce(F.col(c), F.lit(""))), -F.col(order))).alias(c) for c in longest]
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in unions]
    return df.groupBy(key.alias("merge_key")).agg(*picks, *sets, F.min(order).alias(order))
