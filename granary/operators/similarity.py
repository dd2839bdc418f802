"""Set similarity: scaled sketches, classes of scores, and the best score of each query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.sequences import canonical, normalised
from granary.operators.batches import bounded
from granary.operators.lineage import written
from granary.plans import policy

RELATED, NEAR = policy.RELATED, policy.NEAR_DUPLICATE


def shingles(words: Column, size: int) -> Column:
    """Distinct runs of ``size`` words, space-joined; a shorter non-empty text is one shingle."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def kmers(sequence: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters."""
    n = F.length(sequence)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(sequence, i, F.lit(size)))
    return F.when(n >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def canonical_kmers(sequence: Column, size: int, chunk: int = 1 << 20) -> Column:
    """Distinct canonical substrings of ``size`` symbols, none over a symbol that is unknown.

    Long sequences are cut into chunks that overlap by ``size - 1``, so each substring is seen
    once and no list is longer than a chunk before it is made distinct.
    """
    plain = normalised(sequence)
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain), F.lit(1)), F.lit(chunk)), lambda i: F.substring(plain, i, F.lit(chunk + size - 1)))
    clean = lambda c: F.filter(kmers(c, size), lambda x: F.instr(x, "N") == 0)
    return F.array_distinct(F.flatten(F.transform(chunks, lambda c: F.array_distinct(F.transform(clean(c), canonical)))))


def sequence_sketches(records: DataFrame, key: str, sequence: str, size: int, scale: int) -> DataFrame:
    """(key, hashes): the scaled sketch of all records of each key, ascending; no substring spans two records."""
    each = records.select(key, F.explode(scaled_sketch(canonical_kmers(F.col(sequence), size), scale)).alias("h")).distinct()
    found = each.groupBy(key).agg(F.array_sort(F.collect_list("h")).alias("hashes"))
    none = F.array().cast("array<bigint>")
    return records.select(key).distinct().join(found, key, "left").select(key, F.coalesce("hashes", none).alias("hashes"))


def portable_hash(value: Column) -> Column:
    """60 bits of MD5 as a number: the same in any engine."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")


def scaled_sketch(items: Column, scale: int) -> Column:
    """Hashes below 2^60 / scale of the distinct items, ascending."""
    return F.array_sort(F.filter(F.array_distinct(F.transform(items, portable_hash)), lambda h: h < F.lit((1 << 60) // scale)))


def classify(jaccard: Column, near: float = NEAR) -> Column:
    """near_duplicate or related; compare the number itself, not its rendering."""
    return F.when(jaccard >= near, "near_duplicate").otherwise("related")


#: Elements of the sets of one block of queries at most (one set at least), and pairs of elements counted at once.
QUERY_ELEMENTS, AT_ONCE = 2_000_000, 1_000_000
#: Bits of the filter of query elements at most, as a power of two, and bits for each element where they suffice.
MOST_BITS, BITS_EACH = 28, 8


def best_jaccard(sets: DataFrame, queries: DataFrame, key: str, items: str) -> DataFrame:
    """(key, max_jaccard): the best score of each query set against all sets of other keys, 0 where nothing is shared.

    ``items`` are distinct 64-bit hashes.  Queries travel in blocks of bounded size; each block is
    compared with every set in one map, and each task returns its best score by query only.  Where
    there are several blocks, sets are read once, and blocks are compared with what a filter leaves
    of them: elements that no query has are no part of any overlap.  Null
    keys are no queries, null sets are empty, and queries that share a key get one row.
    """
    none = F.array().cast("array<bigint>")
    asked = written(queries.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.coalesce(items, none).alias("x")), "queries")
    total = asked.agg(F.sum(F.size("x"))).first()[0] or 0
    blocks = max(1, -(-total // QUERY_ELEMENTS))
    kind = dict(sets.dtypes)[key]
    block = lambda b: (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)).toArrow()
    sized = sets.select(F.col(key).alias("k"), F.size(F.coalesce(items, none)).alias("n"), F.coalesce(items, none).alias("x"))
    if blocks > 1:
        bits = np.zeros(1 << min(max((BITS_EACH * total).bit_length(), 10) - 3, MOST_BITS - 3), np.uint8)
        for b in range(blocks):
            for at in _bits_of(block(b)["x"].combine_chunks().flatten().to_numpy(), len(bits)):
                np.bitwise_or.at(bits, at >> 3, _BIT[at & 7])
        sized = written(_met(sized, bits, kind), "met")
    best = None
    for b in range(blocks):
        shared = sets.sparkSession.sparkContext.broadcast(_packed_block(block(b)))
        of_block = written(_best_of_block(sized, shared, kind).groupBy("k").agg(F.max("j").alias("j")), "best")
        shared.destroy()  # the driver and executors hold one block at a time
        best = of_block if best is None else best.unionAll(of_block)
    return asked.select("k").distinct().join(best, "k", "left").select(F.col("k").alias(key), F.coalesce("j", F.lit(0.0)).alias("max_jaccard"))


_BIT = (1 << np.arange(8)).astype(np.uint8)


def _bits_of(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each element in a filter of ``size`` bytes, a power of two."""
    x, most = x.view(np.uint64), np.uint64(8 * size - 1)
    return (x & most).astype(np.int64), (x >> np.uint64(32) & most).astype(np.int64)


def _met(sets: DataFrame, bits: np.ndarray, kind: str) -> DataFrame:
    """Sets (k, n, x) with the elements that queries have, by a filter that lets a few others through; n stays the size of the whole set."""
    shared = sets.sparkSession.sparkContext.broadcast(bits)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = shared.value
        for batch in (part for whole in batches for part in bounded(whole, 2, AT_ONCE)):
            column = batch.column(2)
            ends = column.offsets.to_numpy()
            x, ends = column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]
            first, second = _bits_of(x, len(on))
            kept = np.flatnonzero(on[first >> 3] & _BIT[first & 7])
            kept = kept[(on[second[kept] >> 3] & _BIT[second[kept] & 7]) != 0]
            cuts = np.searchsorted(kept, ends)
            rows = pa.array(np.diff(cuts) > 0)
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x[kept]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["k", "n", "x"]).filter(rows)

    return sets.mapInArrow(apply, f"k {kind}, n int, x array<long>")


def _packed_block(block: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Names of queries, sizes of their sets, and all elements, sorted, with the query of each."""
    lists = block["x"].combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy()
    by = np.argsort(flat, kind="stable")
    return block["k"].combine_chunks(), sizes, flat[by], np.repeat(np.arange(len(sizes)), sizes)[by]


def _best_of_block(sets: DataFrame, shared: Broadcast, kind: str) -> DataFrame:
    """(k, j): the best score of each query of a block in each task, over sets (k, n, x) of ``n`` elements."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, values, owner = shared.value
        best = np.zeros(len(names))
        place: dict = {}
        for i, k in enumerate(names.to_pylist()):
            place.setdefault(k, []).append(i)
        for batch in (part for whole in batches for part in bounded(whole, 2, AT_ONCE)):
            keys, whole_size, column = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2)
            ends = column.offsets.to_numpy()
            x, ends = column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]
            low, high = np.searchsorted(values, x), np.searchsorted(values, x, "right")
            met = np.append(0, np.cumsum(high - low))
            a = 0
            while a < len(keys):  # some sets at once, so that what is counted stays bounded
                z = max(a + 1, int(np.searchsorted(met[ends], met[ends[a]] + AT_ONCE, "right")) - 1)
                z = min(z, len(keys))
                span = slice(ends[a], ends[z])
                many = (high - low)[span]
                row = np.repeat(np.arange(ends[a], ends[z]), many)
                at = low[row] + np.arange(len(row)) - (np.cumsum(many) - many)[row - ends[a]]
                of = np.searchsorted(ends[a : z + 1], row, "right") - 1
                pair, n = np.unique(of * len(names) + owner[at], return_counts=True)
                of, query = pair // max(len(names), 1), pair % max(len(names), 1)
                score = n / (sizes[query] + whole_size[a:z][of] - n)
                for i in range(a, z):
                    for q in place.get(keys[i], ()):  # a set is not compared with rows of its own key
                        score[(of == i - a) & (query == q)] = 0
                np.maximum.at(best, query, score)
                a = z
        some = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(best[some])], ["k", "j"])

    return sets.mapInArrow(apply, f"k {kind}, j double")


def sketch_violations(sketches: DataFrame, key: str, hashes: str, scale: int, sizes: DataFrame | None = None) -> DataFrame:
    """(key, rule): sketches that no scaled sketch can be, and keys that have more than one or none.

    Rules are null, unsorted (which repeats are, too), out_of_range and repeated_key; with
    ``sizes`` (key, hash_count) also other_size and missing.
    """
    h = F.col(hashes)
    steps = F.sequence(F.lit(2), F.size(h))
    unsorted = F.when(F.size(h) > 1, F.exists(steps, lambda i: F.element_at(h, i.cast("int")) <= F.element_at(h, (i - 1).cast("int")))).otherwise(False)
    beyond = F.exists(h, lambda x: x.isNull() | (x < 0) | (x >= F.lit((1 << 60) // scale)))
    rules = F.array_compact(F.array(F.when(h.isNull(), "null"), F.when(unsorted, "unsorted"), F.when(beyond, "out_of_range")))
    found = sketches.select(key, F.explode(rules).alias("rule"))
    twice = sketches.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit("repeated_key").alias("rule"))
    out = found.unionByName(twice)
    if sizes is not None:
        own = sketches.select(key, F.coalesce(F.size(h), F.lit(-1)).alias("__n"))
        both = sizes.select(key, "hash_count").join(own, key, "left").filter(~F.col("__n").eqNullSafe(F.col("hash_count")))
        out = out.unionByName(both.select(key, F.when(F.col("__n").isNull(), "missing").otherwise("other_size").alias("rule")))
    return out.distinct()
