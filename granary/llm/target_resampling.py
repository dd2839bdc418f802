"""Importance resampling towards a target distribution, with features from a streaming CRC ring.

One scan of a document's words keeps the running zlib states of the last ``n`` starts.  Each
word extends every open state by a space and the word, and opens a state of its own, so after
each word the ring holds the CRC-32 of every run of 1 to ``n`` words that ends there; their
remainders are the buckets.  No n-gram is ever built as a string.

The first scan counts buckets over all documents and over all target texts (a task sends as many
counts as buckets).  A bucket's gain is its smoothed log ratio of target to documents; a second
scan adds gains up.  Drawing is Gumbel top-k: ``score`` is the mean gain plus noise that is a
function of the key, and the highest scores are drawn by exact ranks over ranges of scores.

Words are runs of characters other than ASCII controls, spaces and marks, A-Z lower-cased.

Defined results: null texts have no words, null keys hash as empty text; a document without
features has weight 0; texts of any length are read whole, by one task, in steps of ``STEP``
words; ties in score go to the smaller key (null first), then to the smaller weight; repeated
rows are each ranked; extra columns are not read; an empty table gives an empty result, and
with an empty target all gains are those of t = T = 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import features
from granary.operators.lineage import written
from granary.operators.numbering import expanded, numbered

LONGEST, BUCKETS, SEED = 2, 10_000, 7
LEAST_WORDS, PERCENT = 20, 25
#: Words whose buckets a task holds at once.
STEP = 1 << 16

#: Bytes as they are read: A-Z lower-cased, what is no part of a word as a space.
_READ = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased, as UTF-8."""
    return text.encode().translate(_READ).split() if text else []


def ring(found: list[bytes], longest: int = LONGEST, states: list[int] | None = None) -> Iterator[int]:
    """CRC-32 of every run of 1 to ``longest`` words, by its last word, then by its length.

    ``states`` are the open starts, newest first; a caller that passes it can read on later.
    """
    states = [] if states is None else states
    for word in found:
        states[:] = [crc32(word), *[crc32(word, crc32(b" ", s)) for s in states[: longest - 1]]]
        yield from states


def _buckets(text: str | None, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, their features' buckets) of a text, in steps."""
    found, states = words(text), []
    for at in range(0, len(found), STEP):
        some = found[at : at + STEP]
        yield len(some), np.fromiter(ring(some, longest, states), np.int64) % buckets


def bucket_counts(df: DataFrame, text: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket occurs in all texts of ``df``; buckets without features are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                for _, found in _buckets(value.as_py(), longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    return df.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket from the counts of documents and of target texts: floor(1000 ln of the smoothed ratio)."""

    def whole(counts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in counts.collect():  # as many rows as buckets, a parameter
            out[r["bucket"]] = r["n"]
        return out

    s, t = whole(documents).astype(np.float64), whole(target).astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(df: DataFrame, text: str, gain: np.ndarray, keep: tuple[str, ...], longest: int = LONGEST) -> DataFrame:
    """Columns ``keep`` of ``df``, and n_words, n_features and weight (the floored mean of gains, 0 without features)."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, len(batch)), np.int64)
            for i, value in enumerate(batch.column(0)):
                n = features_seen = total = 0
                for many, found in _buckets(value.as_py(), longest, len(gain)):
                    n, features_seen, total = n + many, features_seen + len(found), total + int(gain[found].sum())
                out[:, i] = n, features_seen, total // features_seen if features_seen else 0
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x) for x in out)], [*batch.schema.names[1:], "n_words", "n_features", "weight"])

    return df.select(F.col(text).alias("__text"), *keep).mapInArrow(weigh, features.schema(df, keep, "n_words long, n_features long, weight long"))


def resample(
    df: DataFrame, key: str, text: str, target: DataFrame, target_text: str, longest: int = LONGEST, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row; rank is null where a row is not drawn.

    Of the N rows with at least ``least_words`` words the floor(percent N / 100) highest scores are drawn.
    """
    gain = gains(bucket_counts(df, text, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    rows = weighed(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", gain, ("key",), longest)
    scored = written(rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))), "scored")
    eligible = scored.filter(F.col("n_words") >= least_words)
    draws = eligible.count() * percent // 100
    same = eligible.groupBy("key", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("copies")).withColumn("down", -F.col("score"))
    ranked = expanded(numbered(same, ["down", "key", "weight", "n_features"], "at", "copies").drop("down"), "at", "copies")
    names = [F.col("key").alias(key), "n_features", "weight", "score"]
    drawn = ranked.select(*names, F.when(F.col("at") < draws, F.col("at") + 1).alias("rank"))
    return drawn.unionByName(scored.filter(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank")))
