"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

One inserted, deleted or replaced code point leaves half of a word intact: two words that are
near share a prefix (a block of the forward dictionary) or a suffix (a block of the reversed
one).  More exactly, a near pair has one first place where its words differ, and a block is a
range of such places: words of ``m`` or ``m + 1`` code points with the same code points before
the range and after it.  The two halves of a word are two ranges; a block of more than
``MOST_BLOCK`` words is subdivided into the halves of its range, again and again, until the
range is a single place.  There, replaced and inserted code points are two blocks, each as
large as the alphabet of words at most (90), so every block ends within the bound whatever the
dictionary is, and every near pair is in exactly one block, where it counts once.

Blocks are dealt to tasks by hash.  A task sorts its blocks and scans each with a growing
distance; letter sets rule most pairs out, the others are verified on their code points.  No
pair leaves a task: each word gets its number of near words and the best of them.

Forms lead to words that are at least twice as frequent, so chains are short and have no
cycles; roots follow from doubling the links.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, after the
deletions that ``words`` describes.

Defined results: null texts have no words, null keys are written as empty text; texts and words
of any length are read whole; repeated rows count each time; ties between forms go to the
smaller in code-point order; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.lineage import forget, written
from granary.operators.skew import splittable

LEAST_LETTERS, LEAST_COUNT, DROP = 5, 3, 97
#: Words of a block; at least 91, which is what the last subdivision leaves.
MOST_BLOCK = 1024
#: Words of all blocks that a task compares at a time.
GROUP_ROWS = 50_000
#: Different words that a task counts before it sends what it has.
HELD = 400_000
#: Longer words are verified one pair at a time.
LONG = 48

_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str, key: str, drop: int = DROP) -> Iterator[tuple[bytes, int]]:
    """(word, how often) of a text: its runs, of which those whose checksum with the key ``drop`` divides lose a code point."""
    runs = Counter(_RUN.findall(text.encode().translate(_LOWER)))
    for (run, n), h in zip(runs.items(), map(crc32, runs, repeat(crc32(f"{key}:".encode()))), strict=True):
        if h % drop:
            yield run, n
        else:
            whole = run.decode()
            at = h % len(whole)
            yield (whole[:at] + whole[at + 1 :]).encode(), n


def vocabulary(df: DataFrame, key: str, text: str, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``least_letters`` code points that occur at least ``least_count`` times in all texts."""

    def sent(total: dict[bytes, int]) -> pa.RecordBatch:
        long = {w: n for w, n in total.items() if len(w) >= least_letters}
        return pa.RecordBatch.from_arrays([pa.array(list(long), pa.binary()).cast(pa.string()), pa.array(list(long.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words(value.as_py(), name):
                    total[word] += n
                if len(total) > HELD:
                    yield sent(total)
                    total.clear()
        yield sent(total)

    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").filter(F.char_length("word") >= least_letters)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


#: Kinds of a block: all its near pairs, those of equal length only, those of different length only.
ALL, REPLACED, INSERTED = 0, 1, 2


def _block(kind: Column) -> Column:
    """What names the block of a row (word, m, lo, hi): all of the word outside the range of places from lo to hi."""
    word, m, lo, hi = (F.col(c) for c in ("word", "m", "lo", "hi"))
    whole = F.char_length(word)
    before, after = F.substring(word, F.lit(1), lo), F.when(hi < m, F.substring(word, whole - (m - hi) + 1, m - hi)).otherwise("")
    # An insertion at one place: the shorter word is what is left of the longer one.
    left = F.when(whole == m, word).otherwise(F.concat(before, F.substring(word, lo + 2, whole)))
    return F.when(kind == INSERTED, F.xxhash64(kind, m, lo, left)).otherwise(F.xxhash64(kind, m, lo, hi, before, after))


def _rows(ranges: DataFrame) -> DataFrame:
    return ranges.withColumn("block", _block(F.col("kind")))


def _halves(lo: Column, hi: Column) -> Column:
    """The two halves of a range of places; a single place becomes its two kinds."""
    mid = F.floor((lo + hi + 1) / 2).cast("int")
    part = lambda a, b, kind: F.struct(a.alias("lo"), b.alias("hi"), F.lit(kind).alias("kind"))
    return F.when(hi - lo > 1, F.array(part(lo, mid, ALL), part(mid, hi, ALL))).otherwise(F.array(part(lo, hi, REPLACED), part(lo, hi, INSERTED)))


def blocks(vocabulary: DataFrame, most: int = MOST_BLOCK, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n, m, lo, hi, kind, block): every word in its blocks, none of which has more than ``most`` words."""
    sizes = vocabulary.withColumn("whole", F.char_length("word")).withColumn("m", F.explode(F.array(F.col("whole"), F.col("whole") - 1))).filter(F.col("m") >= least_letters)
    cut = F.explode(_halves(F.lit(0), F.col("m") + 1)).alias("r")
    now = written(_rows(sizes.select("word", "n", "m", cut).select("word", "n", "m", "r.*")), "blocks")
    done = None
    while True:
        large = now.groupBy("block").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > most).select("block")
        large = written(large, "large")
        if large.isEmpty():
            return now if done is None else done.unionByName(now)
        small = now.join(splittable(large, "block"), "block", "left_anti")
        done = small if done is None else done.unionByName(small)
        again = now.join(splittable(large, "block"), "block", "left_semi").select("word", "n", "m", F.explode(_halves(F.col("lo"), F.col("hi"))).alias("r")).select("word", "n", "m", "r.*")
        fits = (F.col("kind") == ALL) | (F.char_length("word") == F.col("m")) | (F.col("kind") == INSERTED)
        now = written(_rows(again.filter(fits)), "blocks")


def first_difference(a: str, b: str) -> int:
    """Where two words that are one edit apart first differ, -1 for others; ``a`` is not longer than ``b``."""
    if len(b) - len(a) > 1:
        return -1
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return at if a != b and a[at + (len(a) == len(b)) :] == b[at + 1 :] else -1


class _Dictionary:
    """Words of a task as code points, for verifying many pairs at once."""

    def __init__(self, found: list[str]):
        self.words = found
        self.size = np.fromiter(map(len, found), np.int64, len(found))
        width = int(min(LONG, self.size.max(initial=1))) + 1
        self.codes = np.array([w[:width] for w in found], f"U{width}").view(np.uint32).reshape(len(found), width)
        bits = np.zeros(len(found), np.uint64)
        for c in range(width):
            here = self.codes[:, c]
            bits ^= np.where(here > 0, np.uint64(1) << (here % 61).astype(np.uint64), np.uint64(0))
        self.bits = np.where(self.size <= LONG, bits, np.uint64(0))
        self.whole = self.size <= LONG

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``first_difference`` of pairs of words, shorter ones first."""
        out = np.full(len(a), -1, np.int64)
        short = self.whole[a] & self.whole[b]
        for k in np.flatnonzero(~short).tolist():
            out[k] = first_difference(self.words[a[k]], self.words[b[k]])
        fast = np.flatnonzero(short)
        x, y, m = self.codes[a[fast]], self.codes[b[fast]], self.size[a[fast]]
        same = self.size[a[fast]] == self.size[b[fast]]
        unlike = x != y
        at = np.where(unlike.any(axis=1), unlike.argmax(axis=1), m)
        # What follows the edit must be equal: y from the next place on, x from there or from the same place on.
        off = np.arange(x.shape[1] - 1)
        moved = x[:, :-1] != y[:, 1:]
        inserted = ~(moved & (off >= at[:, None])).any(axis=1)
        near = np.where(same, unlike.sum(axis=1) == 1, inserted & (self.size[b[fast]] == m + 1))
        out[fast] = np.where(near, at, -1)
        return out


def _pairs(block: np.ndarray, bits: np.ndarray, whole: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of equal ``block`` (sorted) whose letters do not rule them out, by distance."""
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(block)))
    left = np.repeat(first + size, size) - np.arange(len(block))  # rows from here to the end of the block
    at, d = np.arange(len(block)), 1
    while True:
        at = at[left[at] > d]
        if not len(at):
            return
        can = (np.bitwise_count(bits[at] ^ bits[at + d]) <= 2) | ~whole[at] | ~whole[at + d]
        if can.any():
            yield at[can], at[can] + d
        d += 1


def _compare(table: pa.Table) -> pa.Table:
    """For each row of a task's blocks with near words: how many there are in its block, and the best."""
    table = table.sort_by([("block", "ascending"), ("word", "ascending")])
    found = table["word"].to_pylist()
    n, m, lo, hi, kind = (table[c].to_numpy() for c in ("n", "m", "lo", "hi", "kind"))
    known = _Dictionary(found)
    # The best word is the most frequent one, then the smallest; Arrow sorts text by code points.
    place = np.empty(len(found), np.int64)
    order = pa.compute.sort_indices(pa.table({"n": table["n"], "word": table["word"]}), sort_keys=[("n", "descending"), ("word", "ascending")]).to_numpy()
    place[order] = np.arange(len(order))
    near, best = np.zeros(len(found), np.int64), np.full(len(found), len(found), np.int64)
    for a, b in _pairs(table["block"].to_numpy(), known.bits, known.whole):
        swap = known.size[a] > known.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        fits = (known.size[a] == m[a]) & np.where(kind[a] == ALL, True, (known.size[b] == m[a]) == (kind[a] == REPLACED))
        a, b = a[fits], b[fits]
        at = known.differ(a, b)
        own = (at >= lo[a]) & (at < hi[a])
        a, b = a[own], b[own]
        for x, y in ((a, b), (b, a)):
            np.add.at(near, x, 1)
            np.minimum.at(best, x, place[y])
    some = np.flatnonzero(near)
    top = order[best[some]] if len(some) else some
    return pa.table({"word": table["word"].take(pa.array(some)), "n_near": near[some], "best_n": n[top], "best": table["word"].take(pa.array(top))})


def near_words(vocabulary: DataFrame, most_block: int = MOST_BLOCK, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n_near, best_n, best): words with near words, how many they have, and the most frequent of them."""
    dealt = blocks(vocabulary, most_block, least_letters)
    groups = max(16, -(-dealt.count() // GROUP_ROWS))
    rows = dealt.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    compared = rows.groupBy("group").applyInArrow(_compare, "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("down"), "best"))
    return compared.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select("word", "n_near", (-F.col("top.down")).alias("best_n"), "top.best")


def roots(links: DataFrame, word: str, form: str) -> DataFrame:
    """(word, root): where following ``form`` from each word with one ends; links must have no cycle."""
    now = written(links.filter(F.col(form).isNotNull()).select(F.col(word).alias("word"), F.col(form).alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(splittable(on, "root"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(now)
        now = after.drop("moved")
        if after.filter("moved").isEmpty():
            return now


def variants(df: DataFrame, key: str, text: str, most_block: int = MOST_BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary of ``df``."""
    known = written(vocabulary(df, key, text), "vocabulary")
    near = near_words(known, most_block)
    leads = F.col("best_n") >= 2 * F.col("n")
    formed = known.join(near, "word", "left").select(
        "word", F.when(leads, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best_n")).alias("form_n")
    )
    formed = written(formed, "forms")
    return formed.join(roots(formed, "word", "form"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
