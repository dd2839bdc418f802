"""The corpus pipeline: raw documents to sharded training documents.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame; all but the last return the columns of ``docs``.  ``run`` writes
each stage's rows to the shared folder, so a lost executor never costs more than the
tasks of one stage.

For every stage: an empty table gives an empty result; null and empty texts are texts
without words; a text of any length is read whole, by one task; repeated rows are each
decided alone, but for the near-duplicate stage; columns beside doc_id and text, whatever
their names and types, come through unchanged, as operators see them as one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, mixing, near_texts, quality, sharding
from granary.llm.queries import DOMAIN
from granary.operators.lineage import forget, written
from granary.sources.tables import table

#: Token shares that the mixing stage aims at; clean documents are all used, none is repeated.
WEIGHTS = {"clean": 0.98, "low": 0.02, "toxic": 0.0}
SHARDS = 40
#: Bytes of rows that go to a Python worker at once, where the session does not say; a larger row goes alone.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def _small_batches(spark: SparkSession) -> None:
    """A batch is held by the JVM, on its way out of the heap, and by a worker; Spark's own bound is 64 MB."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, BATCH_BYTES)


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): what operators read, and all columns as one struct, so that no name clashes."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not select go.

    Equal keys (null among them) draw equal noise; ties at the last place all stay.
    """
    _small_batches(spark)
    drawn = quality.resample(_packed(docs), table(spark, sf_dir, "labels"), "doc_id", "text", F.col("quality") == 1, keep=("doc_id", "row"))
    return drawn.filter("selected").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a 5-word Jaccard of at least 0.8 one row stays.

    It is the row of the smallest doc_id (null last; of rows that share it, that of the smallest
    digest).  Repeated rows are copies; texts without words are one component.
    """
    _small_batches(spark)
    return near_texts.one_of_each(docs, "doc_id", "text")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that align with a benchmark item go; items without an id or words hit nothing."""
    _small_batches(spark)
    hits = decontaminate.with_hits(_packed(docs), "text", table(spark, sf_dir, "benchmark"), "item_id", "text", "hits", keep=("row",))
    return hits.filter(F.size("hits") == 0).select("row.*")


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is drawn once with the chance of its fitted rate; equal keys (null among them) draw alike."""
    _small_batches(spark)
    labels = table(spark, sf_dir, "labels")
    rated, _, _ = mixing.mix(_packed(docs), labels, "doc_id", "text", F.expr(DOMAIN), WEIGHTS, keep=("doc_id", "row"), anchor="clean", most=1.0)
    return rated.filter(mixing.draw(F.col("doc_id")) < F.col("mix_rate")).select("row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard, slot and size of every document that is left; rows that tie on all of these get slots in any order."""
    return sharding.shard_slots(docs, "doc_id", "text", SHARDS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_to_weights", mixing_to_weights),
    ("sharding", sharded),
]

#: Trained models, fingerprints and alignments are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's rows are deleted once the next one's are written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
