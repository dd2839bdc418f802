"""ZIP archives: members with checks, and the text of chosen members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.keys import member_type, safe_path
from granary.sources import streamed

HIGH_RATIO = 1000


def read_zip_members(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """One row per file member of the archives under ``path``; a file that is no archive is one row with an error."""
    members = streamed.read(spark, streamed.ArchiveMembers, path, verify=str(verify).lower())
    return members.withColumns({"member_type": member_type(F.col("member_name")), "safe_path": safe_path(F.col("member_name"))})


def archive_summary(members: DataFrame) -> DataFrame:
    """Counts by archive."""
    file = F.col("member_name").isNotNull()
    twice = members.filter(file).groupBy("path", "member_name").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.sum(F.col("n") - 1).alias("duplicate_member_name_count"))
    sums = members.groupBy("path", "file_size_bytes", "file_sha256").agg(
        F.max("entries").alias("member_count"), F.count_if(file).alias("file_member_count"), F.coalesce(F.sum("uncompressed_bytes"), F.lit(0)).alias("total_uncompressed_bytes"),
        F.coalesce(F.sum("compressed_bytes"), F.lit(0)).alias("total_compressed_member_bytes"), F.count_if("encrypted").alias("encrypted_member_count"), F.count_if(file & ~F.col("safe_path")).alias("unsafe_member_count"),
        F.count_if(F.col("compression_ratio") > HIGH_RATIO).alias("high_compression_ratio_count"), F.count_if("crc_verified").alias("crc_verified_count"), F.count_if(F.col("error_type") != "").alias("crc_failure_count"),
    )
    return sums.join(twice, "path", "left").na.fill(0, ["duplicate_member_name_count"])


def read_member_text(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, member_name, line_number, value) of members whose name matches; .gz members are unpacked, text is strict UTF-8."""
    return streamed.read(spark, streamed.ArchiveLines, path, pattern=pattern)
