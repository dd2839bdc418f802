"""SimHash near-duplicates at a Jaccard similarity of 0.8 on five-word shingles.

64 bits cannot tell a similarity of 0.8: such texts differ in 10 bits or so, and no key of
a few blocks of 64 bits is both equal for them and rare.  So a text's fingerprint is long:
its distinct shingles are dealt by hash to ``shares``, and word ``s`` of the fingerprint is
the 64-bit SimHash (majority of hash bits) of share ``s``.  Words are the pigeonhole blocks.

Sets of at most ``m`` shingles with Jaccard ``t`` or more differ in ``2 m (1 - t) / (1 + t)``
shingles at most.  The number of shares is the first power of two, ``WORDS`` at least, that is
larger by two, so at least two shares of such a pair are equal (all of them empty: less than
once in 10,000 pairs at the very threshold).  Texts with more than ``WORDS`` shares keep the first
``WORDS``; at the very threshold a word is then equal with a chance of 0.37 or more, so a pair
without any is met once in two million.  A set that a partner of other size could move to the
next power is dealt both ways.

Shingles that are common in the whole corpus weigh nothing, as long as a third of a
text's shingles is rare; texts that are mostly common ones also (or only) get words with
equal weights.  So a passage that a third of the corpus quotes makes no common word.  All texts
are counted: shingles fall by hash into ``CLASSES``, and a class is common if so many texts hold
it, and ``OVER`` times as many as a class on average.  So no more than one class in ``OVER`` is common,
without a cap, and what goes to the tasks is a bitmap of fixed size.

Pairs that share a word are kept if their long fingerprints differ in few of the bits of words
that either has (see ``_most``; unrelated texts: half) and their parities do (a bitmap in which
each shingle turns one bit, so two bitmaps differ in no more bits than sets in shingles), then
verified by the exact Jaccard similarity of their whole sets.  Texts with equal sets are one node.  A word first gives only
the pairs of each node with one of its nodes, drawn by hash.  Where its nodes are then still in
several components, they are compared block by block, between components only: the nearest few
pairs of each node are verified, then more, at last all that are left.  So a group of copies never
makes all its pairs, no link between components is lost, and no list has more than two blocks.

Defined results: words are runs of bytes other than ASCII white space, A-Z lower-cased; fewer
than five make one shingle; null texts, empty ones and those without words are one node;
null keys come last; repeated rows are copies; an empty table gives an empty result; extra
columns are kept whatever their names; a text of any length is one row of a task, which needs
about 200 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.components import connected_components
from granary.operators.lineage import forget, written
from granary.operators.near_copies import shingle_hashes
from granary.operators.skew import splittable

SHINGLE, SIMILAR = 5, 0.8
#: 64-bit words of a fingerprint at most.
WORDS = 32
#: Bits in which a fingerprint may differ beyond what its similarity makes likely, as a share; about five standard deviations.
SPREAD = 0.145
#: Shares of rare shingles from which a text has rare words, and up to which it has words of all shingles.
RARE_FROM, ALL_UP_TO = 0.34, 0.6
#: Classes of shingles, and those counted by one group; times the average from which a class is common.
CLASSES, GROUP, OVER = 1 << 24, 1 << 14, 16
#: ``SAMPLE * COMMON`` texts at least must hold a common class.
SAMPLE, COMMON = 16, 6
#: Bits of a parity, and how many more than expected may differ where sets are large; five standard deviations.
PARITY, BEYOND = 1024, 80.0
#: Nodes in a block, and pairs of a node that each visit of a list verifies at most; the last visit takes all.
BLOCK, VISITS = 1024, (4, 64, None)
#: Numbers that choose the node of a word that all others are compared with; fixed, any will do.
SALTS = (0x1B873593CC9E2D51, 0x38495AB5E6546B64, 0x2127599BF4325C37)
#: Places of the bitmap of nodes whose sets are compared.
BITS = 1 << 22
#: Bytes of texts handled at once, and distinct shingles whose votes are counted at once (one text at least).
_STEP, _VOTING = 1 << 20, 1 << 15

_ROW = T.StructType([T.StructField("node", T.LongType()), T.StructField("prints", T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("weighed", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType()))])))])
_SET = T.StructType([T.StructField("node", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))])


def _level(size: np.ndarray, threshold: float) -> np.ndarray:
    """log2 of the number of shares for sets of at most ``size`` shingles."""
    differ = np.floor(2 * (1 - threshold) / (1 + threshold) * size + 1e-9).astype(np.int64)
    return np.maximum(np.ceil(np.log2(differ + 2)), np.log2(WORDS)).astype(np.int64)


def _votes(h: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The SimHash of each run of shingle hashes."""
    spread = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    spread ^= spread >> np.uint64(32)
    out = np.empty(len(first), np.uint64)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(first, first[a] + _VOTING)))
        part = first[a:b]
        end = part[-1] + sizes[b - 1]
        bits = np.unpackbits(spread[part[0] : end].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, part - part[0], axis=0, dtype=np.int32)
        out[a:b] = np.packbits(2 * votes > sizes[a:b, None], axis=1, bitorder="little").view(np.uint64).ravel()
        a = b
    return out


def long_prints(h: np.ndarray, counts: np.ndarray, common: np.ndarray, threshold: float = SIMILAR) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, mode, level, shingles that weigh, words) of each way in which texts are dealt.

    ``h`` has distinct hashes of each text, ascending; ``common`` is a bitmap.  A word of an empty share is zero.
    ``mode`` is 0 for rare shingles and 1 for all.
    """
    of = np.repeat(np.arange(len(counts)), counts)
    rare = ~is_common(h, common)
    rares = np.bincount(of, rare, minlength=len(counts))
    own, other = _level(counts, threshold), _level(np.floor(counts / threshold + 1e-9).astype(np.int64), threshold)
    out = []
    for mode, takes in ((0, rares >= RARE_FROM * counts), (1, rares <= ALL_UP_TO * counts)):
        for level, fits in ((own, takes & (counts > 0)), (other, takes & (counts > 0) & (other != own))):
            texts = np.flatnonzero(fits)
            if not len(texts):
                continue
            share = ((h >> np.uint64(1)) >> (63 - level[of]).astype(np.uint64)).astype(np.int64)
            on = fits[of] & (share < WORDS) & (rare if mode == 0 else True)
            share, by, hash_ = share[on], of[on], h[on]
            words = np.zeros((len(counts), WORDS), np.uint64)
            if len(by):
                first = np.flatnonzero(np.append(True, (by[1:] != by[:-1]) | (share[1:] != share[:-1])))
                words[by[first], share[first]] = _votes(hash_, first, np.diff(np.append(first, len(by))))
            out.append((texts, mode, level[texts], (counts if mode else rares)[texts].astype(np.int64), words[texts]))
    return out


def parities(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bitmap of each set, in which every shingle turns one bit."""
    bit = ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - (PARITY.bit_length() - 1))).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(counts)), counts) * PARITY + bit, minlength=len(counts) * PARITY) & 1
    return np.packbits(odd.astype(bool).reshape(-1, PARITY), axis=1, bitorder="little").view(np.uint64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts (first column) of each take bounded memory."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
        step = np.cumsum(size.astype(np.int64) + PARITY) // _STEP
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def _nodes(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest of each set, 0 for the empty one; where each begins, one entry more)."""
    ends = np.append(0, np.cumsum(counts))
    return np.fromiter((xxhash.xxh64_intdigest(h[a:b].data) if b > a else 0 for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), np.uint64, len(counts)), ends


def _sets(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(node, items) of the texts that are not empty and whose node may be in a bitmap."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in _slices(batches):
            h, counts = shingle_hashes(batch.column(0), SHINGLE)
            node, ends = _nodes(h, counts)
            low = node % np.uint64(BITS)
            on = (node != 0) & (bits[low >> np.uint64(3)] >> (np.uint64(7) - (low & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
            items = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), items], ["node", "items"]).filter(pa.array(on))

    return texts.mapInArrow(apply, _SET)


def _class(h: np.ndarray) -> np.ndarray:
    """The class of each shingle hash."""
    return ((h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - (CLASSES.bit_length() - 1))).astype(np.int64)


def is_common(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which shingle hashes are of a class that a bitmap of ``CLASSES`` has; of an empty one, none."""
    if not len(common):
        return np.zeros(len(h), bool)
    at = _class(h)
    return (common[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _counted(texts: DataFrame) -> DataFrame:
    """(class, n) of every class of shingles: how often all texts hold it, each shingle once a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Two bytes a class; a class is in ``carried`` once for each 65,536 texts.
        total, carried = np.zeros(CLASSES, np.uint16), [np.zeros(0, np.int64)]
        for batch in batches:
            for part in _slices([batch]):  # of fewer texts than that
                at, n = np.unique(_class(shingle_hashes(part.column(0), SHINGLE)[0]), return_counts=True)
                total[at] += n.astype(np.uint16)
                if (over := total[at] < n).any():
                    carried.append(at[over])
        more = np.sort(np.concatenate(carried))
        for a in range(0, CLASSES // GROUP, 64):  # a few groups at once
            n = total[a * GROUP : (a + 64) * GROUP].astype(np.int32)
            np.add.at(n, more[slice(*np.searchsorted(more, (a * GROUP, a * GROUP + len(n))))] - a * GROUP, 1 << 16)
            held = np.flatnonzero(n)
            ends = np.searchsorted(held, np.arange(0, len(n) + 1, GROUP))
            lists = (pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in ((held % GROUP).astype(np.int16), n[held]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(ends) - 1, dtype=np.int32)), *lists], ["group", "places", "n"]).filter(pa.array(np.diff(ends) > 0))

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GROUP, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held + key[0].as_py() * GROUP), pa.array(total[held])], ["class", "n"])

    parts = texts.mapInArrow(count, "group int, places array<smallint>, n array<int>")
    return parts.groupBy("group").applyInArrow(merge, "class long, n long")


def _common(texts: DataFrame, least: int) -> np.ndarray:
    """A bitmap of the classes of shingles that are common in all texts."""
    counted = written(_counted(texts), "classes")
    total = counted.agg(F.sum("n")).first()[0] or 0
    at = counted.filter(F.col("n") >= max(least, -(-OVER * total // CLASSES))).select("class").toArrow().column(0).to_numpy()
    forget(counted)
    common = np.zeros(CLASSES >> 3, np.uint8)
    np.bitwise_or.at(common, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
    return common


def _rows(df: DataFrame, common: np.ndarray, threshold: float) -> DataFrame:
    """The columns of ``df`` but its first, ``text``; the node; the fingerprints."""
    shared = df.sparkSession.sparkContext.broadcast(common)
    more = df.schema.fields[1:]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            h, counts = shingle_hashes(batch.column(0), SHINGLE)
            node, _ = _nodes(h, counts)
            found = long_prints(h, counts, shared.value, threshold)
            texts = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
            by = np.argsort(texts, kind="stable")
            kind = np.concatenate([np.zeros(0, np.int64), *(64 * f[1] + f[2] for f in found)])[by]
            weighed = np.concatenate([np.zeros(0, np.int64), *(f[3] for f in found)])[by]
            words = np.concatenate([np.zeros((0, WORDS), np.uint64), *(f[4] for f in found)])[by]
            texts = texts[by]
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(kind) + 1) * WORDS).astype(np.int32)), pa.array(words.ravel().view(np.int64)))
            turned = parities(h, counts)[texts]
            parity = pa.ListArray.from_arrays(pa.array((np.arange(len(kind) + 1) * turned.shape[1]).astype(np.int32)), pa.array(turned.ravel().view(np.int64)))
            structs = pa.StructArray.from_arrays([pa.array(kind.astype(np.int32)), pa.array(counts[texts].astype(np.int32)), pa.array(weighed.astype(np.int32)), lists, parity], ["kind", "n", "weighed", "words", "parity"])
            ends = np.append(0, np.cumsum(np.bincount(texts, minlength=len(counts)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(node.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), structs)], [*(f.name for f in more), "node", "prints"])

    return df.mapInArrow(apply, T.StructType([*more, *_ROW.fields]))


def _most(na, nb, wa, wb, threshold: float):
    """Share of bits in which similar sets of ``na`` and ``nb`` shingles, ``wa`` and ``wb`` of which weigh, may differ.

    Bits differ about half as often as weighing shingles of the union do; at worst, all
    shingles in which the sets differ weigh.
    """
    differ = (1 - threshold) / (1 + threshold) * (na + nb)
    return SPREAD + differ / (wa + wb + differ)


def _turned(na, nb, threshold: float, least, exp):
    """Bits in which parities of similar sets differ at most: as many as sets in shingles, or fewer where bits are turned twice."""
    differ = (1 - threshold) / (1 + threshold) * (na + nb)
    return least(differ + 1e-6, PARITY / 2 * (1 - exp(differ * (-2 / PARITY))) + BEYOND)


def _close(pairs: DataFrame, prints: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs (kind, a, b) whose sizes fit and whose fingerprints differ in few bits."""
    left, right = (prints.select("kind", *(F.col(c).alias(f"{s}{c}") for c in ("n", "weighed", "words", "parity")), F.col("node").alias(s)) for s in ("a", "b"))
    both = pairs.join(left, ["kind", "a"]).join(right, ["kind", "b"]).filter(F.least("an", "bn") >= F.lit(threshold) * F.greatest("an", "bn") - F.lit(1e-9))
    differ = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = both.filter(differ("aparity", "bparity") <= _turned(F.col("an"), F.col("bn"), threshold, F.least, F.exp))
    bits = differ("awords", "bwords")
    used = F.size(F.filter(F.zip_with("awords", "bwords", lambda x, y: (x != 0) | (y != 0)), lambda x: x))
    return both.filter(bits <= 64 * used * _most(F.col("an"), F.col("bn"), F.col("aweighed"), F.col("bweighed"), threshold)).select("a", "b").distinct()


def _similar(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose whole sets have the similarity."""
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    low = ends.select(F.pmod(F.col("node"), F.lit(BITS)).alias("i")).distinct().toArrow().column(0).to_numpy()
    on = np.zeros(BITS, bool)
    on[low] = True
    met = written(_sets(texts, np.packbits(on)).join(ends, "node", "left_semi").dropDuplicates(["node"]), "met")
    left, right = (met.select(F.col("node").alias(s), F.col("items").alias(f"{s}_x")) for s in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("a_x", "b_x"))
    links = written(both.filter(shared >= F.lit(threshold) * (F.size("a_x") + F.size("b_x") - shared) - F.lit(1e-9)).select("a", "b"), "links")
    forget(met), forget(ends)
    return links


def _nearest(lists: DataFrame, threshold: float, most: int | None) -> DataFrame:
    """(a, b) of close pairs in bounded lists ``members`` (node, n, weighed, c, side, words, parity), between components ``c``.

    In lists of two blocks, only pairs of different sides.  Each node gives its ``most`` nearest.
    """

    def pairs(node: np.ndarray, n: np.ndarray, weighed: np.ndarray, c: np.ndarray, side: np.ndarray, w: np.ndarray, parity: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        two = side.min() != side.max()
        for r in range(len(node)):
            fits = (c != c[r]) & (np.minimum(n, n[r]) >= threshold * np.maximum(n, n[r]) - 1e-9)
            rest = np.flatnonzero(fits & (side != side[r]) if two else fits)
            rest = rest[np.bitwise_count(parity[rest] ^ parity[r]).sum(1) <= _turned(n[rest], n[r], threshold, np.minimum, np.exp)]
            if not len(rest):
                continue
            used = ((w[rest] != 0) | (w[r] != 0)).sum(1)
            differ = np.bitwise_count(w[rest] ^ w[r]).sum(1) / (64 * np.maximum(used, 1))
            near = differ <= _most(n[rest], n[r], weighed[rest], weighed[r], threshold)
            rest, differ = rest[near], differ[near]
            if most is not None and len(rest) > most:
                rest = rest[np.argsort(differ, kind="stable")[:most]]
            yield np.full(len(rest), node[r]), node[rest]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends, values = lists.offsets.to_numpy(), lists.values
            fields = [values.field(f).to_numpy() for f in ("node", "n", "weighed", "c", "side")]
            rows_of = [(x.offsets.to_numpy(), x.values.to_numpy().view(np.uint64)) for x in (values.field("words"), values.field("parity"))]
            out, held = [], 0
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                for pair in pairs(*(f[a:b] for f in fields), *(flat[at[a] : at[b]].reshape(b - a, -1) for at, flat in rows_of)):
                    out.append(pair)
                    held += len(pair[0])
                    if held > 1 << 18:
                        yield rows(out)
                        out, held = [], 0
            yield rows(out)

    def rows(out: list) -> pa.RecordBatch:
        x, y = (np.concatenate([np.zeros(0, np.int64), *(o[f] for o in out)]) for f in range(2))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return lists.select("members").mapInArrow(apply, "a long, b long").distinct()


def _across(named: DataFrame, prints: DataFrame, threshold: float, block: int, most: int | None) -> DataFrame:
    """(a, b) of close pairs between components of nodes that share a word; ``named`` has (key, kind, node, c)."""
    counted = named.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key", "m")
    dealt = named.join(splittable(counted, "key"), "key").join(prints, ["kind", "node"]).withColumn("blocks", F.ceil(F.col("m") / F.lit(block)).cast("int"))
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    spread = dealt.select("key", "node", "n", "weighed", "c", "words", "parity", own.alias("side"), F.explode(cells).alias("cell"))
    lists = spread.groupBy("key", "cell").agg(F.collect_list(F.struct("node", "n", "weighed", "c", "side", "words", "parity")).alias("members"))
    return _nearest(lists, threshold, most)


def components(texts: DataFrame, prints: DataFrame, threshold: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """(node, component) of every node that has a similar other; ``prints`` (node, kind, n, weighed, words) has each once."""
    flat = prints.select("kind", "node", F.posexplode("words").alias("s", "word")).filter("word <> 0")
    keyed = flat.select(F.xxhash64("kind", "s", "word").alias("key"), "kind", "node")
    salt = F.element_at(F.array(*(F.lit(x) for x in SALTS)), (F.pmod("key", F.lit(len(SALTS))) + 1).cast("int"))
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.col("node").bitwiseXOR(salt)).alias("least")).filter("m > 1")
    counted = counted.select("key", F.col("least").bitwiseXOR(salt).alias("rep"))
    shared = written(keyed.join(splittable(counted, "key"), "key"), "shared")
    star = shared.filter("node <> rep").select("kind", F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()
    tried = written(_close(star, prints, threshold), "candidates")
    links = _similar(tried, texts, threshold)
    known = connected_components(links, "a", "b")
    for most in VISITS:
        named = written(shared.join(known, "node", "left").select("key", "kind", "node", F.coalesce("component", "node").alias("c")), "named")
        met = written(_across(named, prints, threshold, block, most), "met")
        forget(named)
        if met.isEmpty():
            break
        rest = written(met.join(tried, ["a", "b"], "left_anti"), "candidates")
        if not rest.isEmpty():
            links, tried = _similar(rest, texts, threshold), tried.unionAll(rest)
            if not links.isEmpty():
                known = connected_components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(links), "a", "b")
    forget(shared), forget(tried)
    return known


def grouped(df: DataFrame, key: str, text: str, threshold: float = SIMILAR, sample: int = SAMPLE, **more: int) -> DataFrame:
    """(row_1, row_2, key, root) of every row: the row's digests, its key, the name of its component of similar texts.

    ``sample`` times ``COMMON`` texts at least must hold a common shingle; all texts are counted.
    """
    texts = df.select(F.col(text).alias("text"))
    common = _common(texts, sample * COMMON)
    rows = written(_rows(df.select(F.col(text).alias("text"), *_digests(df), F.col(key).alias("key")), common, threshold), "fingerprints")
    flat = rows.select("node", F.explode("prints").alias("p")).select("node", "p.*")
    prints = written(flat.groupBy("node", "kind").agg(F.first("n").alias("n"), F.first("weighed").alias("weighed"), F.first("words").alias("words"), F.first("parity").alias("parity")), "prints")
    known = components(texts, prints, threshold, **more)
    forget(prints)
    return rows.select("row_1", "row_2", "key", "node").join(known, "node", "left").select("row_1", "row_2", "key", F.coalesce("component", "node").alias("root"))


def _has_map(kind: T.DataType) -> bool:
    """Whether a type holds a map at any depth; maps cannot be hashed."""
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.MapType) or isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def _digests(df: DataFrame) -> list[Column]:
    """128 bits of a row's values and of which of them are null."""
    values = [F.to_json(F.struct(c.alias("v"))) if _has_map(f.dataType) else c for f, c in zip(df.schema.fields, (F.col(f"`{f.name}`") for f in df.schema.fields), strict=True)]
    return [F.xxhash64(F.lit(i), *(x for v in values for x in (v, v.isNull()))).alias(f"row_{i}") for i in (1, 2)]


def one_of_each(df: DataFrame, key: str, text: str, **more: int) -> DataFrame:
    """The rows of ``df`` but, of each component of similar texts, only that of the smallest (key, text), null keys last.

    Decided on digests and keys alone (and the texts of rows that tie on their keys): texts are
    shuffled once, to leave out the others.  Rows that tie on both are told apart by digest.
    """
    rows = written(grouped(df, key, text, **more), "groups")
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key")).alias("at")
    several = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), least).filter("n > 1").select("root", F.col("at.key").alias("least"))
    members = rows.join(splittable(several, "root"), "root").select("root", "row_1", "row_2", F.col("key").eqNullSafe(F.col("least")).alias("first"))
    members = written(members, "members")
    heads = members.filter("first").groupBy("root").agg(F.countDistinct("row_1", "row_2").alias("n"), F.min(F.struct("row_1", "row_2")).alias("at"))
    heads = written(heads, "heads")
    stay = heads.filter("n = 1").select("root", "at")
    if not heads.filter("n > 1").isEmpty():
        tied = members.filter("first").join(splittable(heads.filter("n > 1").select("root"), "root"), "root").select("root", "row_1", "row_2").distinct()
        read = df.select(F.col(text).alias("text"), *_digests(df)).join(tied, ["row_1", "row_2"])
        by_text = read.groupBy("root").agg(F.min(F.struct("text", "row_1", "row_2")).alias("at"))
        stay = stay.unionAll(by_text.select("root", F.struct("at.row_1", "at.row_2").alias("at")))
    stay = splittable(stay.select("root", F.col("at.row_1").alias("stay_1"), F.col("at.row_2").alias("stay_2")), "root")
    stays = (F.col("row_1") == F.col("stay_1")) & (F.col("row_2") == F.col("stay_2"))
    found = written(members.join(stay, "root").groupBy("row_1", "row_2").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n")), "found")
    forget(rows), forget(members), forget(heads)
    # Rows equal in all columns cannot be told apart: one that stays is drawn from its copies.
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *_digests(df))
    gone = found.filter("not stays or n > 1").select("row_1", "row_2")
    left = packed.join(gone.hint("shuffle_hash"), ["row_1", "row_2"], "left_anti").select("row")
    again = found.filter("stays and n > 1").select("row_1", "row_2")
    if not again.isEmpty():
        copies = packed.join(again, ["row_1", "row_2"], "left_semi").groupBy("row_1", "row_2").agg(F.first("row").alias("row"))
        left = left.unionAll(copies.select("row"))
    return left.select("row.*")
