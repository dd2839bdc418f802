"""Sharding by jump consistent hashing (DataFrame expressions only).

``jump_shard`` is a pure projection: no ring table, no shuffle.  Growing from
``n`` to ``n + 1`` shards moves rows only into the new shard.

``shard_slots`` numbers the rows of each shard from 0 without gaps.  One shard may hold
billions of rows, so a shard is never sorted in one task: rows are numbered in the order of
shard and key over ranges at sampled quantiles (``numbering``), whatever type keys have and
however far one lies from the others, and a shard's first number is taken off.  Rows that are
equal in every numbered column are counted before they are shuffled and expanded afterwards in
chunks, so a row repeated any number of times costs one row in the shuffle.

Defined results: a null key hashes as -1; a null text has size 16 and CRC 0;
an empty table gives an empty result; repeated rows get slots of their own in
one shard; texts of any length are read whole, by one task; extra columns are ignored by ``shard_slots`` and kept by
``with_shard``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.lineage import written
from granary.operators.numbering import expanded, numbered

#: Fixed values of the published jump hash: the multiplier of its generator, and 2 ** 64.
MULTIPLIER, WORD = 2862933555777941757, 18446744073709551616

#: Jumps after which a row has certainly reached its shard: each jump strictly raises the
#: bucket, and for large shard counts the chance of more jumps than this is below 1e-100.
MOST_JUMPS = 128


def _key(key: Column, dtype: str) -> Column:
    whole = key.cast("bigint") if dtype in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)
    whole = F.coalesce(whole, F.lit(-1).cast("bigint"))
    return F.when(whole < 0, whole.cast("decimal(20,0)") + F.lit(str(WORD)).cast("decimal(20,0)")).otherwise(whole.cast("decimal(20,0)")).cast("decimal(20,0)")


def jump_shard(key: Column, dtype: str, shards: int) -> Column:
    """Struct ``(shard, grown)``: the shard of ``key`` among ``shards``, and among ``shards + 1``.

    One walk gives both, since the walk for ``shards + 1`` passes through the answer for
    ``shards``.  Integer keys are used as they are, other types through ``xxhash64``.
    """
    most = min(shards + 1, MOST_JUMPS)
    start = F.struct(_key(key, dtype).alias("k"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("j"))

    def jump(s: Column, _: Column) -> Column:
        k = ((s["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) % F.lit(str(WORD)).cast("decimal(20,0)")).cast("decimal(20,0)")
        landed = F.transform(
            F.array(k),
            lambda v: F.struct(
                v.alias("k"),
                s["j"].alias("b"),
                F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"),
                F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.floor(v / F.lit(8589934592).cast("decimal(10,0)")).cast("double") + 1.0))).cast("bigint").alias("j"),
            ),
        )[0]
        return F.when(s["j"] <= shards, landed).otherwise(s)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(most)), start, jump, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["b"].cast("int").alias("grown"))
    )


def with_shard(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """``df`` and its shard as column ``name`` (replaced if there); a projection, nothing moves."""
    return df.withColumn(name, jump_shard(F.col(key), dict(df.dtypes)[key], shards)["shard"])


def shard_slots(df: DataFrame, key: str, text: str, shards: int, rows_per_range: int = 1_000_000) -> DataFrame:
    """One row per row of ``df``: key, size, text_crc32, law, shard, slot, grown_shard.

    ``rows_per_range`` is the number of different rows that one task numbers at a time; it
    bounds the sort of a task, whatever the number of rows.
    """
    text_col = F.coalesce(F.col(text), F.lit(""))
    seen = (
        df.select(F.col(key).alias("id"), (F.octet_length(text_col).cast("bigint") + 16).alias("size"), F.crc32(text_col.cast("binary")).alias("crc"))
        .groupBy("id", "size", "crc")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("to", jump_shard(F.col("id"), dict(df.dtypes)[key], shards))
        .select("id", "size", "crc", "copies", "to.shard", "to.grown")
    )
    rows = df.count()  # no fewer than there are different ones, and no text is read for it
    placed = written(numbered(seen, ["shard", "id", "size", "crc"], "at", "copies", rows, rows_per_range), "placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    slots = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("at") - F.col("first")).drop("at", "first")  # one row a shard
    return expanded(slots, "slot", "copies").select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", F.col("grown").alias("grown_shard")
    )
