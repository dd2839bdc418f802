"""Exact token counts for every context limit from one length histogram.

Each document is encoded once; documents are then aggregated by encoded length.
Prefix and suffix sums over the histogram answer, for any context limit L, how many
documents fit, how many tokens stay after truncation to L, and every exact quantile
of length: ``truncated_total`` in the row of the largest length not above L, plus
``longer_documents * (L - length)`` for limits between two lengths.

The running sums never order the whole histogram in one task: lengths are cut into
bands, bands are summed, and a running sum over the few bands (their number grows
with the logarithm of the longest text) completes the sums within bands.

Defined results: null and empty texts have length 0; an empty table gives an empty
histogram; repeated rows count each time; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.lineage import written

#: Fixed value: the split pattern published with the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary file is shipped to the executors only up to this size.
MOST_VOCABULARY_BYTES = 64 << 20
#: Lengths below this share one band; above, each doubling has 16 bands.
BAND = 256

_encoders: dict[str, object] = {}


def _encoder(ranks: bytes, pattern: str):
    """The encoder for a vocabulary, built once per Python worker."""
    name = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if name not in _encoders:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        _encoders[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _encoders[name]


def vocabulary(path: str) -> bytes:
    """The vocabulary file, read on the driver; its size is checked before it is shipped."""
    with open(path, "rb") as f:
        ranks = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(ranks) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {MOST_VOCABULARY_BYTES} bytes")
    return ranks


def token_lengths(df: DataFrame, text: str, path: str, pattern: str = PATTERN, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and ``n_tokens`` of every row: whole texts, special strings as plain text."""
    spark: SparkSession = df.sparkSession
    ranks = spark.sparkContext.broadcast(vocabulary(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks.value, pattern).encode_ordinary
        for batch in batches:
            n = pa.array((len(encode(x.as_py())) if x.is_valid else 0 for x in batch.column(0)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], [*keep, "n_tokens"])

    types = dict(df.dtypes)
    return df.select(text, *keep).mapInArrow(count, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "n_tokens long"]))


def _band(n: Column) -> Column:
    """Bands of similar length: exact for short texts' common range, logarithmic above."""
    return F.when(n < BAND, F.lit(0)).otherwise((F.floor(F.log2(n.cast("double")) * 16) - 126).cast("int")).cast("int")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per encoded length, ascending sums below it and what truncation to it leaves.

    The counts by length are written once, so texts are encoded once.
    """
    counts = written(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("documents")), "lengths").withColumn("band", _band(F.col("n_tokens")))
    bands = counts.groupBy("band").agg(F.sum("documents").alias("d"), F.sum(F.col("documents") * F.col("n_tokens")).alias("t"))
    over = "over (order by band rows between unbounded preceding and 1 preceding)"
    bands = bands.select(
        "band",
        F.expr(f"coalesce(sum(d) {over}, 0)").alias("d0"),
        F.expr(f"coalesce(sum(t) {over}, 0)").alias("t0"),
        F.expr("sum(d) over ()").alias("all_documents"),
        F.expr("sum(t) over ()").alias("all_tokens"),
    )
    upto = "over (partition by band order by n_tokens rows unbounded preceding)"
    inner = counts.select("band", "n_tokens", "documents", F.expr(f"sum(documents) {upto}").alias("d1"), F.expr(f"sum(documents * n_tokens) {upto}").alias("t1"))
    fits, tokens = F.col("d0") + F.col("d1"), F.col("t0") + F.col("t1")
    return inner.join(bands, "band").select(
        "n_tokens",
        "documents",
        fits.alias("fitting_documents"),
        (F.col("all_documents") - fits).alias("longer_documents"),
        tokens.alias("fitting_tokens"),
        (F.col("all_tokens") - tokens + F.col("n_tokens") * F.col("documents")).alias("suffix_tokens"),
        (tokens + (F.col("all_documents") - fits) * F.col("n_tokens")).alias("truncated_total"),
        (fits / F.col("all_documents")).alias("quantile"),
        "all_documents",
        "all_tokens",
    )


def limit_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents that fit, tokens in all, and tokens kept after truncation."""
    spark = histogram.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context long")
    picked = [F.struct(*(F.sum(F.when(F.col("n_tokens") <= F.lit(x), v).otherwise(w)).alias(k) for k, v, w in (
        ("fitting_documents", F.col("documents"), F.lit(0)),
        ("total_tokens", F.col("documents") * F.col("n_tokens"), F.col("documents") * F.col("n_tokens")),
        ("kept_tokens", F.col("documents") * F.col("n_tokens"), F.col("documents") * F.lit(x)),
    ))).alias(f"c{x}") for x in limits]
    sums = histogram.agg(*picked)
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(int(x)).alias("context"), f"c{x}.*") for x in limits))).alias("r")).select("r.*")
    return wanted.join(rows, "context", "left").na.fill(0)


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The exact ``q`` quantile of encoded length (the smallest length that at least that share does not exceed)."""
    return histogram.filter(F.col("fitting_documents") >= F.lit(q) * F.col("all_documents")).agg(F.min("n_tokens").alias("n_tokens"))
