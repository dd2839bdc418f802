"""Quality classifier by importance resampling of hashed n-gram models.

Two bag-of-n-grams models over hashed buckets are estimated: ``raw`` over all
documents, ``target`` over labelled good documents.  A document's log importance
weight is the sum over its unigrams and bigrams of log(target / raw).  Adding Gumbel
noise and keeping the ``k`` largest sums draws ``k`` documents without replacement with
chances that follow the weights.  ``k`` is a parameter; where it is not given, it is the expected number of documents that plain
acceptance with probability min(1, weight * exp(3)) would keep: the slack leaves alone
documents that the noise of rare n-grams puts just below weight 1.

Raw counts cover every document.  The target model is fitted on at most
``target_rows`` labelled documents, drawn by a hash of the key; those keys are the only
thing broadcast, and that bound is the proof of their size.  The k-th largest sum is
found by counting sums in ever narrower ranges, never by a global sort or a collect.

Defined results: null and empty texts have no features, log weight 0, and count as
target-like; repeated rows share weight and noise; rows whose sum equals the k-th
largest are all kept; with no labelled good row all weights are 0 and all rows are
kept; labels without a document are ignored, repeated labels count once; texts of any length
are read whole, by one task, in parts; columns ``keep`` come through whatever their names,
but for the three of the result, others are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import features
from granary.operators.lineage import written

BUCKETS = 1 << 16
#: Bound on the labelled rows that the target model is fitted on.
TARGET_ROWS = 20_000
#: Rows of the last range that are fetched to pick the k-th largest sum.
LAST_RANGE = 4096
SMOOTHING = 0.5
#: Counts of a bucket that the raw model contributes to the target model, at a bucket's mean share.
PRIOR = 20.0
#: A document is expected to be kept in full from this log weight up.
SLACK = -3.0
#: A single n-gram moves a log weight by no more than this.
CLIP = 6.0


def _ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, text = features.tokens(texts)
    h2, text2 = features.pairs(h, text)
    return features.bucket(np.concatenate([h, h2]), BUCKETS), np.concatenate([text, text2])


def counts(docs: DataFrame, text: str, target: str) -> np.ndarray:
    """Bucket counts (raw, target) over all documents; ``target`` is a boolean column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            at = 0
            for part in features.parts(batch.column(0)):
                b, i = _ids(part)
                total[0] += np.bincount(b, minlength=BUCKETS)
                total[1] += np.bincount(b[good[at + i]], minlength=BUCKETS)
                at += len(part)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[0, seen]), pa.array(total[1, seen])], ["bucket", "raw", "target"])

    found = docs.select(text, target).mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    out = np.zeros((2, BUCKETS), np.float64)
    for r in found.toLocalIterator():  # one row per bucket at most
        out[:, r["bucket"]] = r["raw"], r["target"]
    return out


def log_ratio(seen: np.ndarray) -> np.ndarray:
    """Smoothed log(target / raw) by bucket; zeros where nothing was labelled."""
    if not seen[1].sum():
        return np.zeros(BUCKETS)
    share = seen.sum(1)
    raw = (seen[0] + SMOOTHING) / (share[0] + SMOOTHING * BUCKETS)
    # The raw model is the target model's prior, so a bucket that labels say nothing about is neutral.
    target = (seen[1] + PRIOR * raw * BUCKETS) / (share[1] + PRIOR * BUCKETS)
    return np.clip(np.log(target / raw), -CLIP, CLIP)


def log_weights(docs: DataFrame, text: str, ratio: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and the log importance weight (log_weight) of every whole text."""
    schema = features.schema(docs, keep, "log_weight double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [np.zeros(0)]
            for part in features.parts(batch.column(0)):
                b, i = _ids(part)
                w.append(np.bincount(i, ratio[b], minlength=len(part)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(w))], [*keep, "log_weight"])

    return docs.select(F.col(text).alias("__text"), *keep).mapInArrow(score, schema)


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on ``key`` and ``seed`` alone."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, value: str, k: int) -> float | None:
    """The exact ``k``-th largest of a double column by counting in ever narrower ranges."""
    if k <= 0:
        return None
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return None
    inside = df.select(F.col(value).alias("v"))
    while True:
        here = inside.filter(F.col("v").between(lo, hi))
        n = here.count()
        if k > n:
            return lo
        if n <= LAST_RANGE or lo == hi:
            return sorted((r["v"] for r in here.orderBy(F.desc("v")).limit(min(k, LAST_RANGE)).collect()), reverse=True)[-1] if lo < hi else lo
        step = (hi - lo) / 1024
        if lo + step == lo or hi - step == hi:  # neighbouring doubles: few distinct values are left
            for r in here.groupBy("v").count().orderBy(F.desc("v")).collect():
                if k <= r["count"]:
                    return r["v"]
                k -= r["count"]
        cells = here.groupBy(F.least(F.floor((F.col("v") - lo) / step), F.lit(1023)).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in sorted(cells.collect(), key=lambda r: -r["c"]):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]


def resample(docs: DataFrame, labels: DataFrame, key: str, text: str, good: Column, seed: int = 11, keep: tuple[str, ...] | None = None, target_rows: int = TARGET_ROWS, k: int | None = None) -> DataFrame:
    """``keep`` (the key, where not given), log_weight, gumbel_key and selected for every document.

    ``labels`` has ``key``; rows of it where ``good`` holds are the target sample.  Sums are
    written once, without texts, to find the k-th largest; weights of the returned rows are
    computed anew from the texts, which gives the same numbers and stores no text.
    """
    ids = labels.filter(good & F.col(key).isNotNull()).select(F.col(key).alias("good_id")).distinct()
    ids = ids.orderBy(F.xxhash64("good_id"), "good_id").limit(target_rows).withColumn("is_good", F.lit(True))
    plain = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    flagged = plain.join(F.broadcast(ids), F.col("__key") == F.col("good_id"), "left")
    ratio = log_ratio(counts(flagged, "__text", "is_good"))

    def scored(columns: tuple[str, ...]) -> DataFrame:
        return log_weights(docs, text, ratio, columns).withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col(key), seed))

    sums = written(scored((key,)), "quality")
    if k is None:
        k = round(sums.agg(F.sum(F.least(F.lit(1.0), F.exp(F.least(F.col("log_weight") - F.lit(SLACK), F.lit(0.0)))))).first()[0] or 0)
    least = kth_largest(sums, "gumbel_key", k)
    out = sums if keep is None else scored(keep)
    return out.withColumn("selected", F.col("gumbel_key") >= F.lit(least) if least is not None else F.lit(False))
