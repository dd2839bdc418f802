"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has a bit set where over half of the document's word-shingle hashes
(XXH64) have it set; repeated shingles count each time.  The 64 bits are split into
``BLOCKS`` blocks.  Two fingerprints with at most ``DISTANCE`` differing bits agree in at
least ``BLOCKS - DISTANCE`` whole blocks, so joining on every choice of that many blocks
finds every close pair exactly; the Hamming distance is then verified.

Documents with the same fingerprint are one node, so copies never make pairs.  Inside a
block bucket only a spanning forest of the verified links is emitted, never all pairs.
With 6 blocks a key has 31 to 33 bits; unrelated fingerprints rarely meet.  Fingerprints
of buckets above ``BUCKET`` are dealt again by choices of 6 of 9 blocks, whose keys leave 22
bits free at most: no list ever holds more than 2^22 fingerprints of 8 bytes.

Defined results: A-Z are lower-cased; words are runs of bytes other than ASCII white
space; null and empty texts (and texts of white space only) have fingerprint zero, which
links like any other; fewer words than a shingle make one shingle; repeated rows belong to
one component; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.components import connected_components
from granary.operators.lineage import written
from granary.operators.skew import splittable

SEED = 42
SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
#: Distinct fingerprints in a bucket beyond which they are dealt again by finer keys.
BUCKET, FINER = 4096, 9
#: Buckets up to this size compare all their fingerprints; larger ones are cut first.
COMPARED_AT_ONCE = 2048
_STEP = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint (unsigned) of one whole text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    if len(words) >= shingle:
        start, end = start[: len(words) - shingle + 1], end[shingle - 1 :]
    else:
        start, end = start[:1], end[-1:]
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(start)
    for at in range(0, n, _STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[at : at + _STEP].tolist(), end[at : at + _STEP].tolist(), strict=True)], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp): fingerprints as signed 64-bit integers."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(bytes(x.as_buffer())) if x.is_valid else 0 for x in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], [key, "fp"])

    return df.select(key, text).mapInArrow(apply, f"`{key}` {dict(df.dtypes)[key]}, fp long")


def masks(blocks: int, distance: int, bits: int = 64) -> list[int]:
    """Bit masks, one for each choice of ``blocks - distance`` blocks of ``bits`` bits."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _links(f: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of close pairs among few fingerprints."""
    close = np.bitwise_count(f[:, None] ^ f[None, :]) <= distance
    return np.nonzero(np.triu(close, 1))


def forest(f: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Label of each distinct fingerprint: the smallest index in its set of linked fingerprints.

    Sorted-order independent and exact: large inputs are cut by byte blocks of all 64
    bits so that every close pair still meets in some part.
    """
    label = np.arange(len(f))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            for side in (i, j):
                np.minimum.at(label, label[side], low)
                np.minimum.at(label, side, low)
            label[:] = label[label]
            if (label == before).all():
                return

    def work(rows: np.ndarray, blocks: int) -> None:
        if len(rows) <= COMPARED_AT_ONCE or blocks > 9:
            for at in range(0, len(rows), COMPARED_AT_ONCE):  # blockwise, so memory stays bounded
                for to in range(at, len(rows), COMPARED_AT_ONCE):
                    a, b = rows[at : at + COMPARED_AT_ONCE], rows[to : to + COMPARED_AT_ONCE]
                    if at == to:
                        i, j = _links(f[a], distance)
                    else:
                        i, j = np.nonzero(np.bitwise_count(f[a][:, None] ^ f[b][None, :]) <= distance)
                    join(a[i], b[j])
            return
        for m in masks(blocks, distance):
            part = f[rows] & np.uint64(m)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order]) != 0) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    work(rows[group], blocks + 2 if len(group) > len(rows) // 2 else blocks + 1)

    work(np.arange(len(f)), 5)
    return label


def bucket_links(buckets: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): spanning-forest links of each bucket of distinct fingerprints (column ``fps``)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            column = batch.column(0)
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            sizes = np.diff(offsets)
            two = offsets[:-1][sizes == 2]  # most buckets: one comparison each, all at once
            a, b = values[two], values[two + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
            out_a.append(a[near])
            out_b.append(b[near])
            for at in np.flatnonzero(sizes > 2):
                f = values[offsets[at] : offsets[at + 1]]
                label = forest(f.view(np.uint64), distance)
                linked = label != np.arange(len(f))
                out_a.append(f[linked])
                out_b.append(f[label[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return buckets.select("fps").mapInArrow(apply, "a long, b long")


def _keyed(nodes: DataFrame, blocks: int, distance: int) -> DataFrame:
    """(fp, choice, part): a row for each choice of blocks, with the bits of these blocks."""
    choices = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("part")) for i, m in enumerate(masks(blocks, distance))))
    return nodes.select("fp", F.explode(choices).alias("k")).select("fp", "k.choice", "k.part")


def near_duplicates(df: DataFrame, key: str, text: str, blocks: int = BLOCKS, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(key, fingerprint, component_id) for every row: component_id is the smallest key reachable by close links."""
    prints = written(fingerprints(df, key, text), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    keyed, by = _keyed(nodes, blocks, distance), ["choice", "part"]
    large = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select(*by)
    finer = _keyed(keyed.join(large, by, "left_semi").select("fp").distinct(), FINER, distance)
    lists = lambda rows: rows.groupBy(*by).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
    buckets = lists(keyed.join(large, by, "left_anti")).unionAll(lists(finer))
    groups = connected_components(bucket_links(buckets, distance), "a", "b").withColumnRenamed("node", "fp")
    roots = nodes.join(groups, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.select("fp", "root").join(splittable(least, "root"), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
