"""GFF3 and GTF lines as a typed feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources import streamed

_PAIR = r'(?:^|;)\s*([A-Za-z0-9_.:-]+)\s+"([^"]*)"'


def attributes(value: Column) -> tuple[Column, Column]:
    """(map, style) of an attribute field: quoted GTF pairs if there is one, else key=value; the last duplicate wins."""
    gtf = value.rlike(r'(?:^|;)\s*\w+\s+"[^"]*"')
    keys, values = F.regexp_extract_all(value, F.lit(_PAIR), F.lit(1)), F.regexp_extract_all(value, F.lit(_PAIR), F.lit(2))
    quoted = F.arrays_zip(keys.alias("k"), values.alias("v"))
    plain = F.transform(F.filter(F.split(value, ";"), lambda p: F.instr(p, "=") > 0), lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    pairs = F.when(gtf, F.transform(quoted, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))).otherwise(plain)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda y: y["k"] == x["k"]))
    style = F.when(gtf, "GTF").when(F.instr(value, "=") > 0, "GFF3").otherwise("UNKNOWN")
    return F.map_from_entries(last), style


def parse(lines: DataFrame, keys: list[str], order: str, line: str = "value", embedded: bool = True) -> DataFrame:
    """Feature, comment and malformed rows of line tables ordered by ``order`` within ``keys``.

    Lines from ``##FASTA`` on are dropped, unless there are none (``embedded``).  Coordinates that are not whole numbers are
    null; lines without nine fields are malformed, not an error.
    """
    stripped = lines.withColumn("__l", F.regexp_replace(line, r"[\r\n]+$", ""))
    body = stripped.filter(F.col("__l") != "")
    if embedded:
        # The first such line of each key, joined back: lines are not sorted, and a key may have any number of them.
        first = stripped.filter(F.col("__l").startswith("##FASTA")).groupBy(*keys).agg(F.min(order).alias("__stop"))
        body = body.join(first, keys, "left").filter(F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).drop("__stop")
    field = F.split("__l", "\t", -1)
    kind = F.when(F.col("__l").startswith("#"), "comment").when(F.size(field) == 9, "feature").otherwise("malformed")
    table, style = attributes(F.get(field, F.lit(8)))
    feature = lambda c: F.when(kind == "feature", c)
    get = lambda i: F.get(field, F.lit(i))
    return body.select(
        *keys, order, kind.alias("kind"), feature(get(0)).alias("seqid"), feature(get(1)).alias("source"), feature(get(2)).alias("type"),
        feature(F.expr("try_cast(get(split(__l, '\t', -1), 3) as bigint)")).alias("start"), feature(F.expr("try_cast(get(split(__l, '\t', -1), 4) as bigint)")).alias("end"),
        feature(get(5)).alias("score"), feature(get(6)).alias("strand"), feature(get(7)).alias("phase"), feature(table).alias("attributes"), feature(style).alias("style"),
        F.when(F.col("__l").startswith("##gff-version"), F.element_at(F.split(F.trim("__l"), r"\s+"), -1)).alias("gff_version"),
    )


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """All plain or .gz files under ``path``, read as streams that end where embedded sequence begins."""
    return parse(streamed.read(spark, streamed.TextLines, path, stop="##FASTA"), ["path"], "line_number", embedded=False)


def strict_features(features: DataFrame) -> DataFrame:
    """(…, seqid, start, end, type) of features; a malformed line or coordinate is an error where it is read."""
    bad = (F.col("kind") == "malformed") | F.col("start").isNull() | F.col("end").isNull()
    rows = features.filter("kind <> 'comment'")
    return rows.withColumn("seqid", F.when(bad, F.raise_error(F.concat(F.lit("malformed line "), F.col("line_number").cast("string")))).otherwise(F.col("seqid")))
