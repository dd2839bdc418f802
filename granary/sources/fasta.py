"""FASTA records through Spark's readers, and an order-true digest of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources import streamed


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, name, sequence) of every record of plain or .gz files under ``path``.

    A record separator splits files at records, so plain files are read by many tasks.  A
    file that does not begin with a header line (blank lines aside) is an error, which one scan
    finds before any record is returned.  A name is the header up to its first white space.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    # Only the first piece of a file keeps its mark; the separator took that of the others.
    headed = F.max(F.col("value").startswith(">") | (F.trim(F.regexp_replace("value", r"\s", "")) == ""))
    bare = raw.groupBy("path").agg(headed.alias("headed")).filter("not headed").limit(3).collect()
    if bare:
        raise ValueError(f"sequence before first header: {', '.join(r['path'] for r in bare)}")
    bare = F.regexp_replace("value", "^>", "")
    header = F.trim(F.regexp_replace(F.split_part(bare, F.lit("\n"), F.lit(1)), "\r", ""))
    body = F.when(F.instr(bare, "\n") > 0, F.expr("substring(regexp_replace(value, '^>', ''), instr(regexp_replace(value, '^>', ''), '\n') + 1)")).otherwise(F.lit(""))
    records = raw.filter(F.trim("value") != "").select("path", header.alias("header"), F.regexp_extract(header, r"^(\S*)", 1).alias("name"), F.regexp_replace(body, r"\s", "").alias("sequence"))
    return records


def file_profile(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, compression, file_sha256, canonical_sha256, error) by file, read as a stream.

    The canonical digest covers a zero byte per header and the upper-cased sequence, in
    file order: it ignores names, case and wrapping.  Compression is told by content.
    """
    rows = streamed.read(spark, streamed.SequenceChunks, path).filter("kind = 'file'")
    return rows.select("path", "size_bytes", "compression", "file_sha256", "canonical_sha256", "error")


def record_digests(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signature, record_count, total_symbols): orientation- and order-free identity of a set of records."""
    from granary.functions.sequences import orientation_digest

    each = records.select(*keys, orientation_digest(F.col("sequence")).alias("d"), F.length("sequence").alias("n"))
    # Record digests are summed as numbers by part, so a set of any size is one aggregate.
    part = lambda i: F.conv(F.substring(F.sha2("d", 256), i, 12), 16, 10).cast("decimal(38,0)")
    sums = F.concat_ws("-", F.lit("orientation-multiset"), *(F.sum(part(i)).cast("string") for i in (1, 13, 25, 37)))
    return each.groupBy(*keys).agg(F.sha2(sums, 256).alias("signature"), F.count(F.lit(1)).alias("record_count"), F.sum("n").cast("bigint").alias("total_symbols"))
