"""Rule gates that keep every reason, evidence predicates, tiers, and unique selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.keys import present, text_bool
from granary.plans import policy

STATUSES = ("REJECTED_HARD_GATE", "REJECTED_ORIENTATION_ALTERNATIVE", "REJECTED_MATERIAL_ALTERNATIVE", "SELECTED")


def reasons(rules: dict[str, Column]) -> Column:
    """Names of all rules that hold, in the order given; a rule on nulls does not hold."""
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))


def reason_counts(df: DataFrame, column: str) -> DataFrame:
    """How many rows each reason rejects."""
    return df.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def best(df: DataFrame, group: list[str], rank: list[Column]) -> DataFrame:
    """The first row of each group by ``rank``; each task keeps one row a group before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*rank))).filter("__n = 1").drop("__n")


def select_unique(df: DataFrame, key: str, passes: str, orientation: str, material: list[str], rank: list[Column]) -> DataFrame:
    """Adds ``status``: the best passing row of each orientation group, then the best of those per material.

    ``key`` is unique and ``rank`` lists orderings, best first, the last one unique.  A group
    with a large share of all rows is never sorted in one task: winners are found by ``best``
    and joined back by key.
    """
    first = best(df.filter(F.col(passes)), [orientation], rank)
    second = best(first, material, rank).select(key, F.lit(True).alias("__second"))
    marks = first.select(key, F.lit(True).alias("__first")).join(second, key, "left")
    status = F.when(~F.coalesce(F.col(passes), F.lit(False)), STATUSES[0]).when(F.col("__first").isNull(), STATUSES[1]).when(F.col("__second").isNull(), STATUSES[2]).otherwise(STATUSES[3])
    return df.join(marks, key, "left").withColumn("status", status).drop("__first", "__second")


#: The labels and ranks below are those of the curated catalogs.
def assembly_tier(level: Column, t2t: Column, n50: Column, share: Column, least_n50: int = policy.LEAST_N50, least_share: float = policy.LEAST_LONG_FRACTION) -> Column:
    """Struct (label, tier, pending); a complete official level wins before any label."""

    def tier(label: str, rank: int, pending: bool) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(rank).alias("tier"), F.lit(pending).alias("pending"))

    marked = F.coalesce(t2t, F.lit(False))
    return (
        F.when(level == "Complete Genome", tier("complete_genome", 4, False))
        .when((level == "Chromosome") & marked, tier("chromosome_official_t2t", 5, False))
        .when(level == "Chromosome", tier("chromosome_official", 3, False))
        .when(marked, tier("t2t_label", 5, True))
        .when((n50 >= least_n50) & (share >= least_share), tier("structural_proxy", 2, True))
        .otherwise(tier("insufficient", 0, True))
    )


def strict_annotation(primary: Column, status: Column, genes: Column, zero: list[Column]) -> Column:
    """Primary, passed, with genes and without faults; a missing count is 0, a bad one fails the row."""
    whole = lambda c: F.coalesce(F.try_to_number(F.coalesce(c.cast("string"), F.lit("0")), F.lit("999999999999999999")).cast("bigint"), F.lit(-1))
    ok = text_bool(primary.cast("string")) & F.coalesce(status == "PASS", F.lit(False)) & (whole(genes) > 0)
    for c in zero:
        ok = ok & (whole(c) == 0)
    return ok


def chromosome_evidence(prefix: Column, texts: list[Column]) -> Column:
    """A chromosome prefix, or a term for whole chromosomes in any text."""
    words = F.lower(F.concat_ws(" ", *texts))
    return F.coalesce(F.trim(prefix) != "", F.lit(False)) | words.rlike("chromosome|pseudomolecule|telomere-to-telomere|telomere to telomere|t2t")


def license_allows(access: Column, license_: Column, accesses: tuple[str, ...] = policy.ACCESS_LEVELS, licenses: tuple[str, ...] = policy.LICENSES) -> Column:
    """Both on their lists after trimming, in any case."""
    return F.lower(F.trim(access)).isin(*(a.lower() for a in accesses)) & F.lower(F.trim(license_)).isin(*(x.lower() for x in licenses))


def provenance(matches: Column, chromosome: Column, sources: list[Column], publications: list[Column]) -> Column:
    """Taxon and chromosome evidence, and a source or a publication."""
    some = F.lit(False)
    for c in [*sources, *publications]:
        some = some | present(c)
    return matches & chromosome & some


def meets_rules(length: Column, identity: Column, rules: list[tuple[int, float]]) -> Column:
    """Any rule (least length, least identity) holds."""
    out = F.lit(False)
    for least_length, least_identity in rules:
        out = out | ((length >= least_length) & (identity >= least_identity))
    return out


def primary_nuclear(name: Column, length: Column, role: Column, location: Column, least: int) -> Column:
    """Not an organelle by name; assembled chromosome by its report, or long enough without one."""
    low = F.lower(name)
    # Names of organelles.
    organelle = low.rlike(r"mitochond|chloroplast|plastid") | low.rlike(r"(^|[._-])(mt|cp|pt)([._-]|$)")
    told = present(role) | present(location)
    official = (F.lower(F.trim(role)) == "assembled-molecule") & F.lower(F.trim(location)).isin("chromosome", "linkage group")
    return ~organelle & F.when(told, F.coalesce(official, F.lit(False))).otherwise(length >= least)


def both_at_least(a: Column, b: Column, least_a: float, least_b: float) -> Column:
    """Two completeness scores at or above their minima."""
    return (a >= least_a) & (b >= least_b)


def source_status(official: Column, resolvable: Column, checks: dict[str, Column], licensed: Column) -> Column:
    """Struct (status, missing): licence review for official rows, pending without a resolver, else by checks."""
    missing = F.array_join(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()))), ";")
    status = F.when(official, "LICENSE_REVIEW_REQUIRED").when(~resolvable, "PENDING_NO_RESOLVER").when(missing != "", "INCOMPLETE_METADATA").when(~licensed, "LICENSE_REVIEW_REQUIRED").otherwise("PASS")
    return F.struct(status.alias("status"), F.coalesce(F.nullif(missing, F.lit("")), F.lit(".")).alias("missing"))
