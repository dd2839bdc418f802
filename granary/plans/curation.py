"""The flagship plan: catalog, hard gates with reasons, two-level selection, intervals and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import audit, gates, intervals, resolve, sampling
from granary.operators.lineage import written
from granary.operators.skew import splittable
from granary.plans import policy

LEAST, MOST = 200, 20_000


def digested(docs: DataFrame) -> DataFrame:
    """Attributes of documents with the digest of their texts, written once: several branches of a plan read them."""
    return written(docs.select("doc_id", "source", "lang", F.col("n_chars").cast("bigint").alias("size"), F.sha2("text", 256).alias("digest")), "digests")


def catalog(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with audit status, exact groups, representatives, and labels spread within exact groups."""
    base = digested(docs)
    passed = labels.filter("quality = 1").select("doc_id")
    status = audit.audit_status(base, passed, labels.filter("quality = 0").select("doc_id"), "doc_id")
    grouped = audit.exact_groups(status, "digest", "exact-", singletons=True, passing=F.col("status") == "PASS")
    ranked = resolve.representative(grouped, "doc_id", ["digest", "status"], [F.col("source"), F.col("doc_id")])
    flag = F.col("is_representative") & (F.col("status") == "PASS")
    return ranked.select("doc_id", "status", "exact_group", "exact_group_size", flag.alias("exact_representative"))


def gated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with every reason against them; no reason means the gate is passed."""
    lab = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    base = digested(docs).join(lab, "doc_id", "left")
    rules = {"unlabelled": F.col("quality").isNull(), "low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "too_short": F.col("size") < LEAST, "too_long": F.col("size") > MOST}
    return base.withColumn("reasons", gates.reasons(rules)).withColumn("passes", F.size("reasons") == 0)


def selected(candidates: DataFrame) -> DataFrame:
    """Of passing documents the largest per exact text, and of those the largest per language and source."""
    return gates.select_unique(candidates, "doc_id", "passes", "digest", ["lang", "source"], [F.desc("size"), F.desc("doc_id")])


def release(sources: DataFrame, spans: DataFrame, masks: DataFrame, contexts: Sequence[int] = policy.CONTEXTS, held: Sequence[str] = ()) -> DataFrame:
    """Selected sources with what is left of their intervals, capacity at each context, split and weight.

    ``sources`` has candidate_id, genus, species and near_group; ``spans`` and ``masks`` have
    candidate_id, start and end.  A near-duplicate group in two splits is an error.
    """
    left = intervals.subtract(spans, masks, ["candidate_id"])
    bases = left.groupBy("candidate_id").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    room = intervals.capacity(left, ["candidate_id"], contexts).groupBy("candidate_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("context", "windows")))).alias("capacity"))
    sizes = sources.groupBy("near_group").agg(F.count(F.lit(1)).alias("near_size"))
    full = sources.join(splittable(sizes, "near_group"), "near_group").join(bases, "candidate_id").join(room, "candidate_id")
    full = full.withColumn("split", sampling.holdout_split(F.col("genus"), held))
    audit.require_empty(sampling.split_leakage(full, "near_group", "split"), "near-duplicate group in two splits")
    return sampling.two_level_weights(full, "species", "bases", ["near_size"], eligible=F.col("split") == "pretrain")
