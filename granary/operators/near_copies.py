"""Texts whose sets of word shingles have a Jaccard similarity of at least a threshold: exact, over whole sets.

Texts with equal sets are one node.  Under any one order of all shingles, two sets of
similarity ``t`` share one of the first ``n - ceil(t n) + 1`` elements of each, so only these
prefixes are dealt to buckets.  The order is by hash, with shingles that a sample of nodes
shows to be common at the end: the sample decides how large buckets get, never which pairs
are found.  Every candidate is verified on whole sets; pairs of a group are verified together, in cells of
two blocks of nodes, so sets are not sent once for each pair.  A set of 64-bit hashes is larger than its
text, so sets are neither stored nor sent: texts go to the cells, compressed, and become sets there.

Small buckets give all their pairs.  Buckets are counted before any is gathered: the members
of a large one are first paired with one of them, drawn by hash; once components are known, a
bucket that still holds several is dealt into cells of two blocks of its members, which give
the pairs between different components only.  So a large group of near copies never makes all
its pairs, and no list is longer than two blocks.

Defined results: words are runs of bytes other than ASCII white space; fewer words than a
shingle make one shingle; null texts and texts without words are one node; shingles and
nodes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.batches import bounded
from granary.operators.components import connected_components
from granary.operators.lineage import forget, written
from granary.operators.skew import splittable

SHINGLE, SIMILAR = 5, 0.8
#: Buckets up to this size give all their pairs at once; members of a block of a larger one.
SMALL, BLOCK = 48, 1024
#: Chooses the member of a large bucket that all others are paired with; fixed, any will do.
SALT = 0x38495AB5E6546B64
#: One node of ``SAMPLE`` is looked at for common shingles; ``COMMON`` of these must hold one; at most ``MOST`` are broadcast.
SAMPLE, COMMON, MOST = 16, 6, 500_000
#: Nodes in a block of the cells in which pairs are verified.
TOGETHER = 64
#: Places of the bitmap of nodes to be verified.
BITS = 1 << 22
#: Bytes of text that are hashed at once.
_STEP = 4 << 20
_EMPTY = np.zeros(0, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: pa.Array, size: int = SHINGLE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the distinct shingle hashes of each text, ascending, and how many each has."""
    rows = len(texts)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts)  # lower-cased below: ascii_lower misreads slices
    flat, offsets = lists.values, lists.offsets.to_numpy()
    flat = flat.slice(offsets[0], offsets[-1] - offsets[0])
    of = np.repeat(np.arange(rows), np.diff(offsets))
    full = pc.greater(pc.binary_length(flat), 0)
    of, flat = of[full.to_numpy(zero_copy_only=False)], flat.filter(full)
    if not len(of):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary())
    data, cuts = distinct.buffers()[2].to_pybytes(), np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1].tolist()
    known = np.fromiter((xxhash.xxh64_intdigest(data[a:b].lower() if lower else data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)), np.uint64, len(distinct))
    words = known[coded.indices.to_numpy()]
    counts = np.bincount(of, minlength=rows)
    begin = np.cumsum(counts) - counts
    left = np.repeat(begin + counts, counts) - np.arange(len(of))  # words from here to the end of the text
    h = np.zeros(len(of), np.uint64)
    for k in range(size):  # all places at once; those that run into the next text are dropped or, in short texts, made below
        n = max(len(of) - k, 0)
        h[:n] = _mix(h[:n] * np.uint64(0xA24BAED4963EE407) + words[k:] + np.uint64(k + 1))
    on = left >= size
    for at, n in zip(begin.tolist(), counts.tolist(), strict=True):
        if 0 < n < size:
            one = np.zeros(1, np.uint64)
            for k in range(n):
                one = _mix(one * np.uint64(0xA24BAED4963EE407) + words[at + k] + np.uint64(k + 1))
            h[at], on[at] = one[0], True
    h, of = h[on], of[on]
    ends = np.append(0, np.cumsum(np.bincount(of, minlength=rows))).tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        h[a:b].sort()
    new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))
    return h[new], np.bincount(of[new], minlength=rows)


def _node_names(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The name of each set; 0 for the empty one."""
    ends = np.append(0, np.cumsum(counts)).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(h[a:b].tobytes()) if b > a else 0 for a, b in zip(ends, ends[1:], strict=False)), np.uint64, len(counts)).view(np.int64)


def shingle_sets(df: DataFrame, text: str, size: int = SHINGLE, lower: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, node, items) of every row: items are the signed hashes of its set, ascending as unsigned; node is 0 for the empty set."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in bounded(batch, len(keep), _STEP)):
            h, counts = shingle_hashes(part.column(len(keep)), size, lower)
            ends = np.append(0, np.cumsum(counts))
            items = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(_node_names(h, counts)), items], [*keep, "node", "items"])

    kinds = dict(df.dtypes)
    return df.select(*keep, F.col(text).alias("__read")).mapInArrow(apply, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "node long", "items array<long>"]))


@dataclass
class Texts:
    """Rows (key, text) whose sets of shingles are made where they are needed, and nowhere stored."""

    rows: DataFrame
    size: int = SHINGLE
    lower: bool = True


@dataclass
class Nodes:
    """Texts with the node of each row (``named``: key, node) and the elements that join nodes (``keyed``: x, node, n, m)."""

    texts: Texts
    named: DataFrame
    keyed: DataFrame
    threshold: float


def _common(texts: Texts, sample: int) -> np.ndarray:
    """Shingles that many sampled nodes hold, ascending."""
    some = shingle_sets(texts.rows.filter(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0), "text", texts.size, texts.lower).dropDuplicates(["node"])
    counts = some.select(F.explode("items").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    top = counts.orderBy(F.desc("n"), "x").limit(MOST).select("x").toArrow().column(0).to_numpy()
    return np.sort(top)


def _first(values: np.ndarray, ends: np.ndarray, late: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The elements of each set by which it is dealt, those in ``late`` last, and how many each set has."""
    n = np.diff(ends)
    of = np.repeat(np.arange(len(n)), n)
    hot = late[np.minimum(np.searchsorted(late, values), len(late) - 1)] == values if len(late) else np.zeros(len(values), bool)
    warm = np.append(0, np.cumsum(hot))  # common ones before each place
    at = np.arange(len(of))
    begin, end = ends[:-1][of], ends[1:][of]
    rank = np.where(hot, end - begin - (warm[end] - warm[at]), at - begin - (warm[at] - warm[begin]))
    most = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
    first = rank < most[of]
    return values[first], np.bincount(of[first], minlength=len(n))


def _dealt(texts: Texts, common: np.ndarray, threshold: float) -> DataFrame:
    """(key, node, n, prefix) of each row, by one reading of its text."""
    shared = texts.rows.sparkSession.sparkContext.broadcast(common)
    size, lower, kind = texts.size, texts.lower, dict(texts.rows.dtypes)["key"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in bounded(batch, 1, _STEP)):
            h, counts = shingle_hashes(part.column(1), size, lower)
            x, many = _first(h.view(np.int64), np.append(0, np.cumsum(counts)), shared.value, threshold)
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_node_names(h, counts)), pa.array(counts.astype(np.int32)), prefix], ["key", "node", "n", "prefix"])

    return texts.rows.select("key", "text").mapInArrow(apply, f"key {kind}, node long, n int, prefix array<long>")


def nodes(df: DataFrame, key: str, text: str, size: int = SHINGLE, threshold: float = SIMILAR, lower: bool = True, sample: int = SAMPLE) -> Nodes:
    """The nodes of all rows; elements are shuffled once, and kept where at least two nodes have them."""
    texts = Texts(df.select(F.col(key).alias("key"), F.col(text).alias("text")), size, lower)
    dealt = written(_dealt(texts, _common(texts, sample), threshold), "dealt")
    named = written(dealt.select("key", "node"), "nodes")
    each = dealt.select(F.explode("prefix").alias("x"), "node", "n").repartition("x").dropDuplicates(["x", "node"])
    counted = each.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("x"))).filter("m > 1")
    keyed = written(counted, "keyed")
    forget(dealt)
    return Nodes(texts, named, keyed, threshold)


def _pairs(buckets: DataFrame, threshold: float, how: str) -> DataFrame:
    """(a, b), a < b, of sizes that can be similar: ``all`` of each list, or those ``across`` components.

    Members have a side; a list with two of them gives pairs of different sides only.
    """

    def of(node: np.ndarray, n: np.ndarray, c: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        by = np.lexsort((node, n))
        node, n, c, side = node[by], n[by], c[by], side[by]
        two = side.min() != side.max()
        to = np.searchsorted(n, n / threshold + 1e-6, side="right")
        for i in range(len(n) - 1):
            j = np.arange(i + 1, to[i])
            if how == "across":
                j = j[c[j] != c[i]]
            if two:
                j = j[side[j] != side[i]]
            if len(j):
                yield np.full(len(j), node[i]), node[j]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends, values = lists.offsets.to_numpy(), lists.values
            node, n, c, side = (values.field(f).to_numpy() for f in ("node", "n", "c", "side"))
            sizes = np.diff(ends)
            two = ends[:-1][sizes == 2]
            fit = (np.minimum(n[two], n[two + 1]) >= threshold * np.maximum(n[two], n[two + 1]) - 1e-9) & ((how != "across") | (c[two] != c[two + 1]))
            out, held = [(node[two[fit]], node[two[fit] + 1])], 0
            for at in np.flatnonzero(sizes > 2):
                for pair in of(*(v[ends[at] : ends[at + 1]] for v in (node, n, c, side))):
                    out.append(pair)
                    held += len(pair[0])
                    if held > 1 << 18:
                        yield rows(out)
                        out, held = [], 0
            yield rows(out)

    def rows(out: list) -> pa.RecordBatch:
        a, b = np.concatenate([_EMPTY, *(x for x, _ in out)]), np.concatenate([_EMPTY, *(y for _, y in out)])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return buckets.select("members").mapInArrow(apply, "a long, b long")


def _promising(buckets: DataFrame, hot: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of small buckets whose prefixes share enough elements to be similar.

    Past the earlier of two prefix ends lie at most ``max(ceil(t n)) - 1`` shared elements; the
    rest of the overlap must be in both prefixes.  Nodes in large buckets (``hot``) may share
    elements that are not counted here, so pairs of two such nodes all stay.
    """
    sizes = buckets.select(F.explode("members").alias("m")).select("m.node", "m.n").distinct()
    held = hot.select(F.col("node").alias("node"), F.lit(True).alias("hot"))
    known = written(sizes.join(held, "node", "left"), "sizes")
    a, b = (known.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("hot").isNotNull().alias(f"h{s}")) for s in ("a", "b"))
    counted = _pairs(buckets, threshold, "all").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).join(a, "a").join(b, "b")
    overlap = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9)
    past = F.ceil(F.lit(threshold) * F.greatest("na", "nb") - 1e-9) - 1
    return counted.filter((F.col("c") >= overlap - past) | (F.col("ha") & F.col("hb"))).select("a", "b")


def _texts_of(texts: Texts, ends: DataFrame) -> DataFrame:
    """(packed, cells) of the rows that ``ends`` (key, cells) names: their texts, compressed; a bitmap of ``BITS`` drops most others first."""
    low = ends.select(F.pmod(F.xxhash64("key"), F.lit(BITS)).alias("i")).distinct().toArrow().column(0).to_numpy()
    on = np.zeros(BITS, bool)
    on[low] = True
    shared = texts.rows.sparkSession.sparkContext.broadcast(np.packbits(on))
    kind = dict(texts.rows.dtypes)["key"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            i = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[i >> 3] >> (7 - (i & 7)).astype(np.uint8) & 1).astype(bool)))
            packed = [_packed(x.as_buffer()) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["key", "packed"])

    held = texts.rows.select("key", "text", F.pmod(F.xxhash64("key"), F.lit(BITS)).alias("i")).mapInArrow(apply, f"key {kind}, packed binary")
    return held.alias("h").join(ends.alias("e"), F.col("h.key").eqNullSafe(F.col("e.key"))).select("packed", "cells")


def _packed(text: pa.Buffer) -> bytes:
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _cells(pairs: DataFrame, block: int) -> DataFrame:
    """(a, b, g, i, j): each pair with the cell in which it is verified; ``pairs`` should be written.

    ``g`` is the smallest of a pair's ends and their neighbours, so most pairs of a group of similar
    nodes share it, and all of a star do.  Nodes of a large ``g`` are dealt to blocks, and a cell has two of these at most.
    """
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("o")).unionAll(pairs.select(F.col("b").alias("node"), F.col("a").alias("o")))
    least = written(both.groupBy("node").agg(F.least("node", F.min("o")).alias("low")), "least")
    low = lambda c: splittable(least.select(F.col("node").alias(c), F.col("low").alias(f"{c}_low")), c)
    named = pairs.join(low("a"), "a").join(low("b"), "b").select("a", "b", F.least("a_low", "b_low").alias("g"))
    named = written(named, "grouped")
    ends = named.select("g", F.explode(F.array("a", "b")).alias("node")).distinct()
    sizes = ends.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks"))
    at = lambda c: F.pmod(F.xxhash64(c, "g"), F.col("blocks")).cast("int")
    return named.join(splittable(sizes, "g"), "g").select("a", "b", "g", F.least(at("a"), at("b")).alias("i"), F.greatest(at("a"), at("b")).alias("j"))


def _scores(met: DataFrame, cells: DataFrame, threshold: float, sets: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b, jaccard) of the similar pairs of each cell; ``sets`` makes (nodes, ends, elements) of the rows of ``met`` in a cell."""
    kind = "a long, b long, jaccard double"

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        nodes, ends, values = sets(left)
        by = np.argsort(nodes, kind="stable")
        first, second = (by[np.searchsorted(nodes[by], right.column(c).to_numpy())] for c in ("a", "b"))
        shared = np.fromiter((len(np.intersect1d(values[ends[x] : ends[x + 1]], values[ends[y] : ends[y + 1]], assume_unique=True)) for x, y in zip(first.tolist(), second.tolist(), strict=True)), np.int64, len(first))
        n = np.diff(ends)
        jaccard = shared / (n[first] + n[second] - shared)
        return pa.table([right.column("a"), right.column("b"), pa.array(jaccard)], ["a", "b", "jaccard"]).filter(pa.array(jaccard >= threshold))

    cell = ["g", "i", "j"]
    return met.groupBy(*cell).cogroup(cells.groupBy(*cell)).applyInArrow(score, kind)


def _listed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets that were sent as such."""
    lists = rows.column("items").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return rows.column("node").to_numpy(), lists.offsets.to_numpy(), lists.values.to_numpy()


def _verified(pairs: DataFrame, sets: DataFrame | Nodes, threshold: float, block: int = TOGETHER) -> DataFrame:
    """(a, b, jaccard) of the pairs that are similar; ``pairs`` should be written.

    Pairs are verified in cells, so a set is sent once to each cell that it is in, not once for each pair.
    ``sets`` are nodes of texts, which are sent in place of their sets, or rows (node, items).
    """
    cells = written(_cells(pairs, block), "cells")
    seats = cells.select("g", "i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = seats.groupBy("node").agg(F.collect_list(F.struct("g", "i", "j")).alias("cells"))
    if isinstance(sets, DataFrame):
        met = sets.dropDuplicates(["node"]).join(ends, "node").select("node", "items", F.explode("cells").alias("cell")).select("cell.*", "node", "items")
        return _scores(met, cells, threshold, _listed)
    size, lower = sets.texts.size, sets.texts.lower

    def from_texts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = pa.array([None if x is None else _unpacked(x) for x in rows.column("packed").to_pylist()], pa.large_binary()).cast(pa.large_string())
        h, counts = shingle_hashes(texts, size, lower)
        return _node_names(h, counts), np.append(0, np.cumsum(counts)), h

    heads = sets.named.groupBy("node").agg(F.min("key").alias("key"))
    ends = written(ends.join(heads, "node").groupBy("key").agg(F.flatten(F.collect_list("cells")).alias("cells")), "ends")
    met = _texts_of(sets.texts, ends).select("packed", F.explode(F.array_distinct("cells")).alias("cell")).select("cell.*", "packed")
    return _scores(met, cells, threshold, from_texts)


def _lists(keyed: DataFrame) -> DataFrame:
    """(members) of each element of ``keyed``, whose elements should have few nodes each."""
    member = F.struct("node", "n", F.lit(0).cast("bigint").alias("c"), F.lit(0).alias("side"))
    return keyed.groupBy("x").agg(F.collect_list(member).alias("members")).select("members")


def node_pairs(made: Nodes, small: int = SMALL) -> DataFrame:
    """(a, b, jaccard) of every similar pair of nodes."""
    keyed, threshold = made.keyed, made.threshold
    many = keyed.filter(F.col("m") > small)
    hot = many.select("node").distinct()
    few = _promising(_lists(keyed.filter(F.col("m") <= small)), hot, threshold)
    alone = many.select(F.col("x").alias("k"), "node", "n", "m", F.col("node").alias("c"))  # each its own component: all pairs
    pairs = written(few.unionAll(_across(alone, threshold)).distinct(), "candidates")
    return _verified(pairs, made, threshold)


def _across(named: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b) between components ``c`` of the nodes that share an element ``k`` (m of them), cell by cell."""
    blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node", "k"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    spread = named.select("k", F.struct("node", "n", "c", own.alias("side")).alias("member"), F.explode(cells).alias("cell"))
    lists = spread.groupBy("k", "cell").agg(F.collect_list("member").alias("members"), F.min("member.c").alias("lo"), F.max("member.c").alias("hi")).filter("lo <> hi")
    return _pairs(lists, threshold, "across")


def node_components(made: Nodes, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(node, component) of every node that has a similar other."""
    keyed, threshold = made.keyed, made.threshold
    many = written(keyed.filter(F.col("m") > small), "large")
    hot = many.select("node").distinct()
    salted = F.col("node").bitwiseXOR(F.lit(SALT))
    pivots = many.groupBy("x").agg(F.min(F.struct(salted.alias("h"), "node", "n")).alias("p")).select("x", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"))
    star = many.join(splittable(pivots, "x"), "x").filter((F.col("node") != F.col("pivot")) & (F.least("n", "pn") >= F.lit(threshold) * F.greatest("n", "pn") - F.lit(1e-9)))
    star = star.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    few = _promising(_lists(keyed.filter(F.col("m") <= small)), hot, threshold)
    pairs = written(few.unionAll(star).distinct(), "candidates")
    links = written(_verified(pairs, made, threshold).select("a", "b"), "links")
    if not many.isEmpty():
        known = connected_components(links, "a", "b")
        named = written(many.join(known, "node", "left").select(F.col("x").alias("k"), "node", "n", "m", F.coalesce("component", "node").alias("c")), "named")
        mixed = named.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("k")
        met = _across(named.join(splittable(mixed, "k"), "k"), threshold, block)
        rest = written(met.distinct().join(pairs, ["a", "b"], "left_anti"), "candidates")
        links = links.unionAll(_verified(rest, made, threshold).select("a", "b"))
    return connected_components(links, "a", "b")


def clusters(df: DataFrame, key: str, text: str, size: int = SHINGLE, threshold: float = SIMILAR, lower: bool = True, sample: int = SAMPLE, **more: int) -> DataFrame:
    """(key, component_id) for every row: component_id is the smallest key reachable by similar texts."""
    made = nodes(df, key, text, size, threshold, lower, sample)
    groups = node_components(made, **more)
    named = made.named.join(groups, "node", "left").select("key", F.coalesce("component", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("key").alias("component_id"))
    return named.join(least.repartition(F.xxhash64("root")), "root").select(F.col("key").alias(key), "component_id")
