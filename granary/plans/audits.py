"""Summaries and joins over audit results: one aggregate or a few equi-joins each, over tables of any size."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import audit
from granary.operators.skew import splittable
from granary.plans import policy

#: What stands in a manifest for a value that is not there.
NONE = "."


def _one_row(*parts: DataFrame) -> DataFrame:
    """Tables of one row each side by side, without a join."""
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.agg(*(F.max(c).alias(c) for c in every.columns))


def sequence_audit(registry: DataFrame, results: DataFrame, failures: DataFrame, key: str, digest: str) -> DataFrame:
    """``registry`` with status, the columns of ``results``, and exact groups over the digests of passed rows."""
    status = audit.audit_status(registry, results, failures, key, exclusive=True)
    return audit.exact_groups(status.join(results, key, "left"), digest, "exact_", singletons=False, passing=F.col("status") == "PASS")


def audit_summary(audited: DataFrame, digest: str, totals: list[str]) -> DataFrame:
    """One row: candidates by status, exact groups and members, and each of ``totals`` over all passed rows and over distinct digests.

    Rows of one digest have equal totals, so the first of each digest is any of them; digests
    are counted before they are shuffled.
    """
    passed = audited.filter("status = 'PASS'")
    by_digest = passed.groupBy(digest).agg(F.count(F.lit(1)).alias("__n"), *(F.min(t).alias(t) for t in totals))
    unique = by_digest.agg(
        F.count(F.lit(1)).alias("unique_count"), F.count_if(F.col("__n") > 1).alias("duplicate_group_count"), F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n"))), F.lit(0)).alias("duplicate_member_count"),
        *(F.coalesce(F.sum(t), F.lit(0)).cast("bigint").alias(f"unique_{t}") for t in totals),
    )
    states = audited.agg(
        F.count(F.lit(1)).alias("candidate_count"), *(F.count_if(F.col("status") == s).alias(f"{s.lower()}_count") for s in ("PASS", "FAIL", "MISSING")),
        *(F.coalesce(F.sum(F.when(F.col("status") == "PASS", F.col(t))), F.lit(0)).cast("bigint").alias(f"total_{t}") for t in totals),
    )
    return _one_row(states, unique)


def map_text(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """(keys, counts, total): counts of ``name`` as compact JSON text with sorted names, and their sum."""
    sums = df.groupBy(*keys, name).agg(F.sum(value).cast("bigint").alias("__n"))
    pair = F.struct(F.col(name).alias("name"), F.concat(F.to_json(F.array(name)).substr(F.lit(2), F.length(F.to_json(F.array(name))) - 2), F.lit(":"), F.col("__n").cast("string")).alias("text"))
    listed = F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["text"])
    return sums.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}")).alias("counts"), F.sum("__n").cast("bigint").alias("total"))


def compatible_taxa(df: DataFrame, group: str, genus: str, species: str) -> DataFrame:
    """(group, taxa, compatible): at most one taxon, or one genus and one binomial (first two words)."""
    binomial = F.array_join(F.slice(F.split(F.trim(species), r"\s+"), 1, 2), " ")
    counts = df.groupBy(group).agg(F.countDistinct(F.struct(genus, species)).alias("taxa"), F.countDistinct(genus).alias("__genera"), F.countDistinct(binomial).alias("__binomials"))
    return counts.select(group, "taxa", ((F.col("taxa") <= 1) | ((F.col("__genera") == 1) & (F.col("__binomials") == 1))).alias("compatible"))


def quality_rank(key: str) -> list[Column]:
    """Order of candidates, best first: by eight columns of the quality table, the last being the key."""
    return [
        F.desc("assembly_tier"), F.desc("long_callable_fraction"), F.asc("n_fraction"), F.desc("large_sequence_fraction"),
        F.desc("n50"), F.asc("contig_count"), F.desc("base_count"), F.desc(key),
    ]


def sketch_candidate(status: Column, representative: Column, hardmasked: Column, total: Column, unknown: Column, most: float = policy.MOST_N_FRACTION_SKETCH) -> Column:
    """Passed, a representative, not masked for good, and with few unknown symbols."""
    fine = (status == "PASS") & representative & ~hardmasked & (total > 0) & (unknown <= F.lit(most) * total)
    return F.coalesce(fine, F.lit(False))


def by_list(df: DataFrame, key: str, listed: str, separator: str = ";") -> DataFrame:
    """(member, key) for every member of the lists in ``listed``; "." and empty members stand for none."""
    member = F.explode(F.split(F.coalesce(F.col(listed), F.lit("")), separator)).alias("member")
    return df.select(key, member).filter(~F.trim("member").isin("", NONE)).select(F.trim("member").alias("member"), key).distinct()


def with_defaults(candidates: DataFrame, key: str, *parts: DataFrame) -> DataFrame:
    """``candidates`` with the text columns of each of ``parts`` (one row a key), "." where a part has none."""
    out = candidates
    for part in parts:
        out = out.join(part, key, "left").withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in part.columns if c != key})
    return out


def annotation_catalog(files: DataFrame, members: DataFrame, key: str, constant: dict[str, str]) -> DataFrame:
    """Files and archive members as one table; columns that one side lacks are ``constant`` there, else "."; ids must be unique."""
    shared = [*files.columns, *(c for c in members.columns if c not in files.columns)]

    def side(df: DataFrame, kind: str, given: dict[str, str]) -> DataFrame:
        return df.select(F.lit(kind).alias("source_kind"), *(F.col(c).cast("string").alias(c) if c in df.columns else F.lit(given.get(c, NONE)).alias(c) for c in shared))

    every = side(files, "file", {}).unionByName(side(members, "zip_member", constant))
    copies = every.groupBy(key).agg(F.count(F.lit(1)).alias("__copies"))
    sure = F.when(F.col("__copies") > 1, F.raise_error(F.concat(F.lit("id is not unique: "), F.col(key)))).otherwise(F.col(key))
    return every.join(splittable(copies, key), key).withColumn(key, sure).drop("__copies")


def subset_violations(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Contract of a proper subset: keys of ``part`` that ``whole`` lacks, and a row ``all`` if nothing else is in ``whole``."""
    a, b = part.select(key).distinct(), whole.select(key).distinct()
    strange = a.join(b, key, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit("not in whole").alias("rule"))
    rest = b.join(a, key, "left_anti").agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return strange.unionByName(rest.select(F.lit("all").alias("key"), F.lit("not proper").alias("rule")))


def unseen(declared: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Declared keys (queries) that no record came from."""
    return declared.select(key).distinct().join(seen.select(key), key, "left_anti")


def literature_key(doi: Column, title: Column, year: Column) -> Column:
    """The DOI, or else the normalised title and the year."""
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("doi|"), doi)).otherwise(F.concat_ws("|", F.lit("title"), F.coalesce(title, F.lit("")), F.coalesce(year.cast("string"), F.lit(""))))


def literature_order(title: str, year: str, doi: str) -> list[Column]:
    """Order of a merged literature table: year (none first), title, DOI."""
    return [F.coalesce(F.col(year), F.lit(0)), F.col(title), F.coalesce(F.col(doi), F.lit(""))]


def similarity_summary(candidates: DataFrame, pairs: DataFrame, components: DataFrame) -> DataFrame:
    """One row: candidates, pairs compared, related and near-duplicate pairs, near-duplicate groups and members.

    ``components`` has component and component_size of every candidate.
    """
    n = candidates.agg(F.count(F.lit(1)).alias("candidate_count"))
    found = pairs.agg(F.count(F.lit(1)).alias("related_pair_count"), F.count_if(F.col("classification") == "near_duplicate").alias("near_duplicate_pair_count"))
    groups = components.filter("component_size > 1").agg(F.count(F.lit(1)).alias("group_member_count"), F.countDistinct("component").alias("group_count"))
    compared = (F.col("candidate_count") * (F.col("candidate_count") - 1) / 2).cast("bigint").alias("compared_pair_count")
    return _one_row(n, found, groups).select("candidate_count", compared, "related_pair_count", "near_duplicate_pair_count", "group_count", "group_member_count")


def tasks(candidates: DataFrame, key: str, reasons: str) -> tuple[DataFrame, DataFrame]:
    """(tasks numbered from 1 by key, counts of the reasons why others are none); ``key`` is a bigint."""
    from granary.operators.gates import reason_counts
    from granary.operators.shards import task_index

    return task_index(candidates.filter(F.size(reasons) == 0).select(key), key), reason_counts(candidates, reasons)


def receipt_violations(inventory: DataFrame, receipt: DataFrame, path: str = "path", size: str = "size_bytes", digest: str | None = None) -> DataFrame:
    """Contract: files of a receipt that are missing, unexpected, or of another size (or digest)."""
    more = [size, *([digest] if digest else [])]
    a = inventory.select(path, F.struct(*more).alias("__is"))
    b = receipt.select(path, F.struct(*more).alias("__said"))
    rule = F.when(F.col("__is").isNull(), "missing").when(F.col("__said").isNull(), "unexpected").when(F.col("__is") != F.col("__said"), "changed")
    return a.join(b, path, "full").select(path, rule.alias("rule")).filter("rule is not null")
