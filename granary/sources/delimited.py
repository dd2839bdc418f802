"""Delimited tables and tool outputs: always with a stated schema, bad rows are an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.gates import meets_rules
from granary.operators.intervals import merge_inclusive
from granary.plans import policy

#: Columns of tabular alignment output with the query length last.
ALIGNMENT = "query_id string, subject_id string, percent_identity double, alignment_length long, mismatches long, gap_opens long, query_start long, query_end long, subject_start long, subject_end long, e_value double, bit_score double, query_length long"


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header line that must name the columns of ``schema`` in order."""
    return spark.read.options(sep="\t", header=True, mode="FAILFAST", enforceSchema=False, quote="").schema(schema).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON object per file; without ``strict``, unreadable files are rows with only ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).options(multiLine=True, mode="FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").options(multiLine=True, mode="PERMISSIVE").json(path)


def report_fields(lines: DataFrame, keys: list[str], line: str = "value") -> DataFrame:
    """(keys, field, value) of ``# field: value`` lines."""
    field, value = F.regexp_extract(line, r"^#\s*([^:]+):\s*(.*)$", 1), F.trim(F.regexp_extract(line, r"^#\s*([^:]+):\s*(.*)$", 2))
    return lines.select(*keys, F.trim(field).alias("field"), value.alias("value")).filter("field <> ''")


def report_table(lines: DataFrame, keys: list[str], columns: list[str], line: str = "value") -> DataFrame:
    """Rows of a report whose column line is a comment: every line that is no comment, split by tabs."""
    parts = F.split(F.regexp_replace(line, r"\r$", ""), "\t", -1)
    return lines.filter(~F.col(line).startswith("#") & (F.trim(line) != "")).select(*keys, *(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)))


def vector_hits(hits: DataFrame, rules: Sequence[tuple[int, float]] = policy.VECTOR_RULES) -> DataFrame:
    """(query_id, hits, longest, bases): confident alignments by query, their merged length, longest first."""
    good = hits.filter(meets_rules(F.col("alignment_length"), F.col("percent_identity"), rules))
    spans = merge_inclusive(good.select("query_id", F.col("query_start").alias("start"), F.col("query_end").alias("end")), ["query_id"])
    bases = spans.groupBy("query_id").agg(F.sum(F.col("end") - F.col("start") + 1).cast("bigint").alias("bases"))
    each = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("alignment_length").alias("longest"))
    return each.join(bases, "query_id").orderBy(F.desc("bases"), "query_id")


def half_open(start: Column, end: Column) -> tuple[Column, Column]:
    """1-based closed coordinates as 0-based half-open ones, either way round."""
    return (F.least(start, end) - 1).cast("bigint"), F.greatest(start, end).cast("bigint")


def chunk_classes(calls: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class, chunks, bases): a chunk's final class is its second-stage one unless that is empty or n/a."""
    final = F.coalesce(F.nullif(F.nullif(F.trim("second"), F.lit("")), F.lit("n/a")), F.col("first"))
    joined = calls.select("chunk_id", final.alias("class")).join(chunks, "chunk_id")
    return joined.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("chunks"), F.sum("length").cast("bigint").alias("bases"))


def bibliography(items: DataFrame, query: Column) -> DataFrame:
    """Search-result items (JSON text in ``item``) as literature rows."""
    from granary.functions.text import doi

    schema = "DOI string, title array<string>, `container-title` array<string>, publisher string, URL string, type string, author array<struct<family:string,given:string>>, published struct<`date-parts`:array<array<int>>>"
    j = F.from_json("item", schema)
    person = lambda a: F.concat_ws(", ", F.nullif(F.trim(a["family"]), F.lit("")), F.nullif(F.trim(a["given"]), F.lit("")))
    authors = F.array_join(F.filter(F.transform(j["author"], person), lambda s: s != ""), "; ")
    first = lambda c: F.coalesce(F.trim(F.get(c, F.lit(0))), F.lit(""))
    return items.select(
        doi(j["DOI"]).alias("doi"), first(j["title"]).alias("title"), first(j["container-title"]).alias("journal"), F.get(F.get(j["published"]["date-parts"], F.lit(0)), F.lit(0)).alias("year"),
        F.coalesce(F.trim(j["publisher"]), F.lit("")).alias("publisher"), F.coalesce(authors, F.lit("")).alias("authors"), F.coalesce(F.trim(j["URL"]), F.lit("")).alias("url"),
        F.coalesce(F.trim(j["type"]), F.lit("")).alias("publication_type"), F.array(query).alias("query_ids"), F.array(F.lit("crossref")).alias("sources"),
    )


def single_json(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The one JSON object in the one file of that name below ``folder``; none or several are an error."""
    found = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder, mode="FAILFAST")
    n = found.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if not n else 'more than one'} {pattern} below {folder}")
    return found
