"""Roll-ups and release checks over quality results: each is a join and one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import audit, gates, intervals
from granary.plans import policy

#: Classes whose chunks are masked; "unknown" is not among them.
MASKED = ("archaea", "bacteria", "prokarya", "organelle", "mitochondria", "plastid")
PROKARYOTIC = ("archaea", "bacteria", "prokarya")


def record_quality(records: DataFrame, classes: DataFrame, vector: DataFrame, least_evaluated: float = policy.LEAST_EVALUATED, most_prokaryotic: float = policy.MOST_PROKARYOTIC, most_vector: float = policy.MOST_VECTOR, least_nuclear: float = policy.LEAST_NUCLEAR_FRACTION) -> DataFrame:
    """One row per candidate: primary bases and what was evaluated, prokaryotic and vector shares, reasons, status.

    ``records`` has candidate_id, record_id, length and is_primary; ``classes`` has
    candidate_id, record_id, class and bases; ``vector`` has candidate_id, record_id and bases.
    """
    found = classes.groupBy("candidate_id", "record_id").agg(
        F.sum("bases").alias("evaluated"), F.sum(F.when(F.col("class").isin(*PROKARYOTIC), F.col("bases")).otherwise(0)).alias("prokaryotic"),
        F.sum(F.when(F.col("class") == "unknown", F.col("bases")).otherwise(0)).alias("unknown"), F.sum(F.when(F.col("class").isin("organelle", "mitochondria", "plastid"), F.col("bases")).otherwise(0)).alias("organelle"),
    )
    hits = vector.groupBy("candidate_id", "record_id").agg(F.sum("bases").alias("vector"))
    full = records.join(found, ["candidate_id", "record_id"], "left").join(hits, ["candidate_id", "record_id"], "left")
    mine = lambda c: F.coalesce(F.sum(F.when(F.col("is_primary"), F.col(c))), F.lit(0)).cast("bigint")
    sums = full.groupBy("candidate_id").agg(
        F.sum("length").cast("bigint").alias("base_count"), F.count_if("is_primary").alias("primary_record_count"),
        *(mine(c).alias(f"primary_{n}") for c, n in (("length", "bases"), ("evaluated", "evaluated_bases"), ("prokaryotic", "prokaryotic_bases"), ("unknown", "unknown_bases"), ("organelle", "organelle_bases"), ("vector", "vector_bases"))),
    )
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 12)
    out = sums.withColumns({"nuclear_fraction": share("primary_bases", "base_count"), "evaluated_fraction": share("primary_evaluated_bases", "primary_bases"), "prokaryotic_fraction": share("primary_prokaryotic_bases", "primary_evaluated_bases"), "vector_fraction": share("primary_vector_bases", "primary_bases")})
    rules = {"LOW_NUCLEAR": F.col("nuclear_fraction") < least_nuclear, "LOW_EVALUATED": F.col("evaluated_fraction") < least_evaluated, "PROKARYOTIC": F.col("prokaryotic_fraction") > most_prokaryotic, "VECTOR": F.col("vector_fraction") > most_vector}
    return out.withColumn("reasons", gates.reasons(rules)).withColumn("status", F.when(F.size("reasons") == 0, "PASS").otherwise("FAIL"))


def masks(chunks: DataFrame, vector: DataFrame) -> DataFrame:
    """(candidate_id, record_id, start, end, sources): half-open unions of masked chunks and vector hits.

    Chunks have half-open coordinates already; vector hits are 1-based and closed.
    """
    a = chunks.filter(F.col("class").isin(*MASKED)).select("candidate_id", "record_id", "start", "end", F.concat(F.lit("chunk:"), "class").alias("source"))
    b = vector.select("candidate_id", "record_id", (F.least("start", "end") - 1).alias("start"), F.greatest("start", "end").alias("end"), F.lit("vector").alias("source"))
    return intervals.merge_sources(a.unionByName(b), ["candidate_id", "record_id"], "source")


def completeness(tasks: DataFrame, results: DataFrame, modes: tuple[str, ...] = ("annotation", "genome"), least: float = policy.LEAST_COMPLETE_GENOME) -> DataFrame:
    """Nested completeness results as flat columns by mode, with a gate and a status.

    ``results`` has candidate_id, elapsed_seconds, error and one struct per mode with
    complete, single, duplicated, fragmented and missing percentages.
    """
    fields = ("complete", "single", "duplicated", "fragmented", "missing")
    flat = results.select("candidate_id", "elapsed_seconds", "error", *(F.col(f"{m}.{f}").cast("double").alias(f"{m}_{f}_percent") for m in modes for f in fields))
    joined = tasks.join(flat, "candidate_id", "left")
    whole = F.lit(True)
    for m in modes:
        for f in fields:
            whole = whole & F.col(f"{m}_{f}_percent").isNotNull()
    good = F.lit(True)
    for m in modes:
        good = good & (F.col(f"{m}_complete_percent") >= least)
    status = F.when(F.col("elapsed_seconds").isNull(), "MISSING").when(F.coalesce("error", F.lit("")) != "", "ERROR").when(~whole, "ERROR").when(good, "PASS").otherwise("FAIL")
    return joined.withColumn("status", status)


def merged_modes(combined: DataFrame, halves: list[DataFrame], modes: tuple[str, ...]) -> DataFrame:
    """Combined results where there are any, else both halves joined with their seconds summed (3 places)."""
    left = halves[0].select("candidate_id", F.col("elapsed_seconds").alias("__s0"), modes[0])
    right = halves[1].select("candidate_id", F.col("elapsed_seconds").alias("__s1"), modes[1])
    both = left.join(right, "candidate_id").select("candidate_id", F.round(F.col("__s0") + F.col("__s1"), 3).alias("elapsed_seconds"), *modes)
    fresh = both.join(combined.select("candidate_id"), "candidate_id", "left_anti")
    return combined.select("candidate_id", "elapsed_seconds", *modes).unionByName(fresh)


def release_violations(sources: DataFrame, spans: DataFrame, callable_: DataFrame, capacities: DataFrame, contexts: list[int]) -> DataFrame:
    """(candidate_id, rule): everything wrong with a release; it may be published when this is empty."""
    keys = ["candidate_id", "record_index"]

    def said(df: DataFrame, rule: str) -> DataFrame:
        return df.select(F.col("candidate_id").cast("string").alias("candidate_id"), F.lit(rule).alias("rule")).distinct()

    bad = said(audit.duplicates(sources, ["candidate_id"]), "duplicate source")
    bad = bad.unionByName(said(spans.filter((F.col("start") < 0) | (F.col("end") <= F.col("start"))), "bad coordinates"))
    bad = bad.unionByName(said(intervals.overlap_violations(spans, keys), "overlapping intervals"))
    bad = bad.unionByName(said(intervals.contained(spans.select(*keys, "start", "end"), callable_, keys).filter("not inside"), "outside callable intervals"))
    bad = bad.unionByName(said(sources.join(spans.select("candidate_id").distinct(), "candidate_id", "left_anti"), "no interval"))
    bad = bad.unionByName(said(spans.select("candidate_id").distinct().join(sources, "candidate_id", "left_anti"), "interval without source"))
    fit = intervals.capacity(spans, ["candidate_id"], contexts)
    declared = capacities.select("candidate_id", F.col("context").cast("bigint").alias("context"), F.col("windows").alias("__told"))
    off = fit.join(declared, ["candidate_id", "context"], "full").filter(~F.col("windows").eqNullSafe(F.col("__told")))
    bad = bad.unionByName(said(off, "capacity differs"))
    return bad.unionByName(said(sources.join(audit.conflicts(sources, ["near_group"], "split"), "near_group", "left_semi"), "group in two splits"))


def unreferenced(stores: DataFrame, sources: DataFrame) -> DataFrame:
    """Stores that no released source names, with the bytes that removing them would free."""
    return stores.join(sources.select("candidate_id").distinct(), "candidate_id", "left_anti")


def archive_candidates(members: DataFrame, archives: DataFrame, inventory: DataFrame, kind: str) -> DataFrame:
    """Sound members of sound archives: safe, verified, of one kind, and of the size the inventory has.

    A size that differs is an error where it is read.
    """
    fine = members.filter((F.col("member_type") == kind) & F.col("safe_path") & F.col("crc_verified") & ~F.col("encrypted"))
    joined = fine.join(archives.select("path", F.col("size_bytes").alias("__size")), "path").join(inventory.select("path", F.col("size_bytes").alias("__listed")), "path")
    sure = F.when(F.col("__size") != F.col("__listed"), F.raise_error(F.concat(F.lit("size differs: "), F.col("path")))).otherwise(F.col("__size"))
    ident: Column = F.substring(F.sha2(F.concat_ws("\0", "path", "member_name"), 256), 1, 16)
    return joined.withColumn("archive_size_bytes", sure).withColumn("candidate_id", ident).drop("__size", "__listed")
