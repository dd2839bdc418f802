"""Profiles in one scan: N50, symbol counts, sequence files, feature files, and coordinate closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.sequences import AMBIGUOUS, symbol_count
from granary.plans import policy


def n50(df: DataFrame, keys: list[str], length: str) -> DataFrame:
    """(keys, n50): the largest length such that lengths from it up hold half of the total; 0 for nothing.

    Lengths are counted first, so the window sorts distinct lengths, not rows.
    """
    n = F.coalesce(F.col(length), F.lit(0)).cast("bigint")
    counts = df.groupBy(*keys, n.alias("__n")).agg(F.sum(n).alias("__sum"))
    down = Window.partitionBy(*keys).orderBy(F.desc("__n")).rowsBetween(Window.unboundedPreceding, 0)
    marked = counts.withColumns({"__reach": F.sum("__sum").over(down), "__all": F.sum("__sum").over(Window.partitionBy(*keys))})
    return marked.groupBy(*keys).agg(F.coalesce(F.max(F.when((F.col("__all") > 0) & (2 * F.col("__reach") >= F.col("__all")), F.col("__n"))), F.lit(0)).cast("bigint").alias("n50"))


def symbol_histogram(df: DataFrame, keys: list[str], text: str, symbols: str) -> DataFrame:
    """(keys, symbol, n): occurrences of each stated symbol, absent ones as 0."""
    sums = df.groupBy(*keys).agg(*(F.coalesce(F.sum(symbol_count(F.col(text), c)), F.lit(0)).alias(f"s{i}") for i, c in enumerate(symbols)))
    pairs = F.array(*(F.struct(F.lit(c).alias("symbol"), F.col(f"s{i}").alias("n")) for i, c in enumerate(symbols)))
    return sums.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.symbol", "p.n")


def chunk_profile(chunks: DataFrame, keys: list[str], record: str = "record", symbols: str = "symbols", long: int = policy.LONG_SEQUENCE, most_n: float = policy.MOST_N_FRACTION) -> DataFrame:
    """Statistics by file of records that are stored as chunk rows (keys, record, name, symbols), as ``sources.streamed`` reads them.

    Beside those of ``sequence_profile``: the share of symbols in records of at least ``long``,
    the share of N, and whether that is at most ``most_n``.  Chunks are counted where they are
    read; only sums are shuffled.
    """
    s = F.coalesce(F.col(symbols), F.lit(""))
    upper = F.upper(s)
    each = chunks.groupBy(*keys, record).agg(
        F.min("name").alias("name"), F.sum(F.length(s)).cast("bigint").alias("n"), F.sum(symbol_count(upper, "ACGT")).alias("acgt"), F.sum(symbol_count(upper, "GC")).alias("gc"),
        F.sum(symbol_count(upper, "N")).alias("unknown"), F.sum(symbol_count(upper, AMBIGUOUS)).alias("ambiguous"), F.sum(symbol_count(s, "abcdefghijklmnopqrstuvwxyz")).alias("lower"),
    )
    sums = each.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("sequence_count"), (F.count("name") - F.countDistinct("name")).cast("bigint").alias("duplicate_header_count"), F.count_if(F.col("n") == 0).cast("bigint").alias("empty_sequence_count"),
        F.sum("n").alias("total_symbols"), F.min("n").alias("min_sequence_length"), F.max("n").alias("max_sequence_length"), F.sum("acgt").alias("acgt_count"), F.sum("gc").alias("gc_count"), F.sum("unknown").alias("n_count"),
        F.sum("ambiguous").alias("iupac_ambiguous_count"), F.sum("lower").alias("lowercase_count"), F.coalesce(F.sum(F.when(F.col("n") >= long, F.col("n"))), F.lit(0)).alias("large_symbols"),
    )
    total = F.nullif(F.col("total_symbols"), F.lit(0))
    sums = sums.withColumns({"invalid_symbol_count": F.col("total_symbols") - F.col("acgt_count") - F.col("n_count") - F.col("iupac_ambiguous_count"), "large_sequence_fraction": F.coalesce(F.col("large_symbols") / total, F.lit(0.0)), "n_fraction": F.coalesce(F.col("n_count") / total, F.lit(0.0))})
    return sums.withColumn("n_fraction_passes", F.col("n_fraction") <= most_n).drop("large_symbols").join(n50(each, keys, "n"), keys)


def sequence_profile(records: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics by file of a record table (keys, name, sequence), as ``sources.fasta`` reads it."""
    plain = records.withColumn("__s", F.regexp_replace(F.coalesce("sequence", F.lit("")), r"\s", ""))
    n, upper = F.length("__s"), F.upper("__s")
    sums = plain.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("sequence_count"),
        (F.count("name") - F.countDistinct("name")).cast("bigint").alias("duplicate_header_count"),
        F.count_if(n == 0).cast("bigint").alias("empty_sequence_count"),
        F.sum(n).cast("bigint").alias("total_symbols"),
        F.min(n).cast("bigint").alias("min_sequence_length"),
        F.max(n).cast("bigint").alias("max_sequence_length"),
        F.sum(symbol_count(upper, "ACGT")).alias("acgt_count"),
        F.sum(symbol_count(upper, "GC")).alias("gc_count"),
        F.sum(symbol_count(upper, "N")).alias("n_count"),
        F.sum(symbol_count(upper, AMBIGUOUS)).alias("iupac_ambiguous_count"),
        F.sum(n - F.length(F.regexp_replace("__s", "[a-z]", ""))).cast("bigint").alias("lowercase_count"),
    )
    sums = sums.withColumn("invalid_symbol_count", F.col("total_symbols") - F.col("acgt_count") - F.col("n_count") - F.col("iupac_ambiguous_count"))
    return sums.join(n50(plain.withColumn("__len", n), keys, "__len"), keys)


def feature_profile(features: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics by file of a feature table, as ``sources.gff`` reads it (malformed lines are rows too)."""
    good = F.col("kind") == "feature"
    kind = F.lower("type")
    valid = good & F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") >= 1) & (F.col("end") >= F.col("start"))
    sums = features.groupBy(*keys).agg(
        F.count_if(good).alias("feature_count"),
        F.count_if(F.col("kind") == "comment").alias("comment_line_count"),
        F.count_if(F.col("kind") == "malformed").alias("malformed_line_count"),
        F.count_if(good & ~F.coalesce(valid, F.lit(False))).alias("invalid_coordinate_count"),
        F.count_if(good & ~F.col("strand").isin("+", "-", ".", "?")).alias("invalid_strand_count"),
        F.count_if(good & ~F.col("phase").isin("0", "1", "2", ".")).alias("invalid_phase_count"),
        F.count_if(good & (kind == "gene")).alias("gene_count"),
        F.count_if(good & kind.isin("mrna", "transcript")).alias("transcript_count"),
        F.count_if(good & (kind == "cds")).alias("cds_count"),
        F.count_if(good & (kind == "exon")).alias("exon_count"),
        F.countDistinct(F.when(valid, F.col("seqid"))).alias("seqid_count"),
        F.max("gff_version").alias("gff_version"),
        F.count_if(good & (F.col("style") == "GTF")).alias("__gtf"),
        F.count_if(good & (F.col("style") == "GFF3")).alias("__gff"),
    )
    out = sums.withColumn("format", F.when(F.coalesce("gff_version", F.lit("")) != "", "GFF3").when((F.col("__gtf") == 0) & (F.col("__gff") == 0), "UNKNOWN").when(F.col("__gtf") > F.col("__gff"), "GTF").otherwise("GFF3")).drop("__gtf", "__gff")
    for name, kinds, second in (("gene", ("gene",), "gene_id"), ("transcript", ("mrna", "transcript"), "transcript_id")):
        attribute = lambda k: F.nullif(F.try_element_at("attributes", F.lit(k)), F.lit(""))
        ids = features.filter(good & kind.isin(*kinds)).select(*keys, F.coalesce(attribute("ID"), attribute(second)).alias("id")).filter("id is not null")
        each = ids.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n"))
        found = each.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"unique_{name}_id_count"), F.sum(F.col("n") - 1).alias(f"duplicate_{name}_id_count"))
        out = out.join(found, keys, "left").na.fill(0, [f"unique_{name}_id_count", f"duplicate_{name}_id_count"])
    return out


def max_end(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seqid, max_end) over features with sound coordinates."""
    sound = features.filter((F.col("kind") == "feature") & (F.col("start") >= 1) & (F.col("end") >= F.col("start")))
    return sound.groupBy(*keys, "seqid").agg(F.max("end").alias("max_end"))


def smallest(df: DataFrame, keys: list[str], value: str, most: int, name: str) -> DataFrame:
    """(keys, ``name``): the ``most`` smallest values of each key, ascending.

    A rank that is bounded by a number is cut in each task before rows are shuffled, so a key
    with very many values sends ``most`` from each task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def closure(features: DataFrame, contigs: DataFrame, keys: list[str], seqid: str = "seqid", start: str = "start", end: str = "end", kind: Column | None = None, preview: int = 20) -> DataFrame:
    """Do all features lie on known records and within them?  One row per key with counts and a status.

    ``contigs`` has keys, seqid and length, one row each.  Unknown names are counted distinct
    first.  The preview holds the ``preview`` smallest of them, which each task picks before any
    is shuffled; ``unknown_digest`` is a sum over all of them, equal for equal sets in any order.
    """
    gene = F.lower("type") == "gene" if kind is None else kind
    known = contigs.select(*keys, F.col(seqid).alias("__seq"), F.col("length").alias("__len"))
    on = [features[k] == known[k] for k in keys] + [features[seqid] == known["__seq"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = features.join(known, cond, "left").select(*(features[k] for k in keys), features[seqid].alias("__id"), gene.alias("__gene"), F.col("__len"), ((features[start] < 1) | (features[end] < features[start]) | (features[end] > F.col("__len"))).alias("__out"))
    by_name = joined.groupBy(*keys, "__id", F.col("__len").isNull().alias("__unknown")).agg(F.count(F.lit(1)).alias("n"), F.count_if("__gene").alias("g"), F.count_if(F.col("__out")).alias("o"))
    number = F.conv(F.substring(F.md5(F.col("__id").cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = by_name.groupBy(*keys).agg(
        F.sum("n").cast("bigint").alias("feature_count"), F.sum("g").cast("bigint").alias("gene_count"), F.count_if(~F.col("__unknown")).alias("matched_seqid_count"),
        F.count_if("__unknown").alias("unknown_seqid_count"), F.sum("o").cast("bigint").alias("out_of_bounds_feature_count"),
        F.coalesce(F.sum(F.when(F.col("__unknown"), number)), F.lit(0)).cast("string").alias("unknown_digest"),
    )
    few = smallest(by_name.filter("__unknown"), keys, "__id", preview, "unknown_preview")
    few = few.withColumnsRenamed({k: f"__few_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__few_{k}")) for k in keys]
    sums = sums.join(few, same, "left").drop(*(f"__few_{k}" for k in keys))
    sums = sums.withColumn("unknown_preview", F.coalesce("unknown_preview", F.array().cast(sums.schema["unknown_preview"].dataType)))
    good = (F.col("feature_count") > 0) & (F.col("gene_count") > 0) & (F.col("unknown_seqid_count") == 0) & (F.col("out_of_bounds_feature_count") == 0)
    return sums.withColumn("status", F.when(good, "PASS").otherwise("FAIL"))
