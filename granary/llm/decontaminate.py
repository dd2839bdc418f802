"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are cut into word n-grams.  One pass over the corpus counts the documents
that hold each of them; the rare ones, and the rarest of every ``SPACING`` neighbouring
n-grams of an item, become its seeds, so no item loses all its seeds however common its
passage is.  Items of equal words are aligned once.  A second pass finds seeds in whole
documents, takes the passage around each, and aligns its words with the item's (match +2,
mismatch and gap -1).  A pair is reported when the score reaches ``threshold`` of the item's
own score, which passages with replaced, dropped or added words still do.

N-grams that more than ``SHARED`` items have (a common lead) would align each of these items
with every document that quotes the lead.  An item that such n-grams cover to less than
``threshold`` needs words of its own in the passage as well: at least so many that one of its
``own words`` (all but as many as it needs, less one; the rarest) must be there.  So a shared
n-gram is a seed of it only with one of these words near it.  A pair is looked at if the passage
has as many of the item's words as the threshold takes.  All
such items of a passage are scored side by side, and only those that reach the threshold are
aligned.  No item and no passage is left out by this, since a score is at most twice the number
of matches.

Both passes are maps over Arrow batches.  Test items travel to the executors in blocks
of at most ``MOST_BLOCK_BYTES``; a larger benchmark takes one pair of passes per block.
Words are compared by 64-bit hashes; equal passages met again in a task are not aligned
again.

Defined results: null and empty texts and items match nothing; items shorter than an
n-gram seed by their whole sequence; repeated items and rows are each reported; item ids must
be whole numbers (anything else is an error), items without an id are ignored; extra
columns are kept by ``with_hits`` whatever their names; of passages that tie in score the first
is reported; texts of any length are read whole, by one task; empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import features

NGRAM = 3
SPACING = 2
#: An n-gram is rare up to this share of all documents, or this number of them.
RARE, FEW = 0.001, 64
#: Unrelated passages of the given tables score below 0.35; copies with two fifths of their words replaced score 0.4.
THRESHOLD = 0.4
MATCH, OTHER = 2, 1
#: Items that may share an n-gram before it takes a word of their own to align them.
SHARED = 32
MOST_BLOCK_BYTES = 16 << 20
#: Cells of a column of all items that are scored side by side.
CELLS = 1 << 16
#: Aligned passages that a task remembers.
REMEMBERED = 4096

HIT = "array<struct<item_id:long,score:double,first_word:long,last_word:long>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every word: runs of letters, digits and non-ASCII, case folded."""
    return features.tokens(pc.utf8_lower(texts), marks=False)


@dataclass
class Items:
    """A block of test items: words as numbers of a small vocabulary, and the n-grams; items of equal words are one."""

    ids: list[list[int]]
    vocabulary: np.ndarray
    words: list[np.ndarray]
    grams: np.ndarray
    gram_of: list[np.ndarray]

    @classmethod
    def build(cls, ids: list[int], texts: list[str]) -> Items:
        h, text = words(pa.array(texts, pa.string()))
        vocabulary, number = np.unique(h, return_inverse=True)
        cuts = np.searchsorted(text, np.arange(len(ids) + 1))
        same: dict[bytes, list[int]] = {}
        for i, w in zip(ids, np.split(number.astype(np.int64), cuts[1:-1]), strict=True):
            same.setdefault(w.tobytes(), []).append(i)
        own = [np.frombuffer(w, np.int64) for w in same]
        keys = [_grams(w, len(vocabulary)) for w in own]
        grams = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]))
        return cls(list(same.values()), vocabulary, own, grams, [np.searchsorted(grams, k) for k in keys])

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of word hashes, -1 for other words."""
        return _lookup(self.vocabulary, h)


def _lookup(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _grams(w: np.ndarray, size: int) -> np.ndarray:
    """n-gram keys of a sequence of vocabulary numbers; short sequences have one key of all their words."""
    n = min(NGRAM, len(w))
    if not n:
        return np.zeros(0, np.int64)
    key = np.zeros(len(w) - n + 1, np.int64)
    for j in range(NGRAM):
        key = key * (size + 1) + (w[j : j + len(key)] + 1 if j < n else 0)
    return key


def _found(items: Items, part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, text of each word, gram numbers found, word positions where they start)."""
    h, text = words(part)
    w = items.numbers(h)
    grams, places = [], []
    for n in range(1, NGRAM + 1):
        if n < NGRAM and not any(len(x) == n for x in items.words):
            continue
        if len(w) < n:
            continue
        m = len(w) - n + 1
        good = text[:m] == text[n - 1 :]
        for j in range(n):
            good &= w[j : j + m] >= 0
        at = np.flatnonzero(good)
        key = np.zeros(len(at), np.int64)
        for j in range(NGRAM):
            key = key * (len(items.vocabulary) + 1) + (w[at + j] + 1 if j < n else 0)
        g = _lookup(items.grams, key)
        grams.append(g[g >= 0])
        places.append(at[g >= 0])
    if not grams:
        return w, text, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return w, text, np.concatenate(grams), np.concatenate(places)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: (best score, first and last word of the passage that it covers)."""
    n = len(passage)
    steps = np.arange(n + 1) * OTHER
    score, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, first, last = 0, 0, -1
    for x in item:
        diagonal = score[:-1] + np.where(passage == x, MATCH, -OTHER)
        up = score[1:] - OTHER
        now = np.maximum(np.maximum(diagonal, up), 0)
        begin = np.where(now == 0, np.arange(1, n + 1), np.where(diagonal >= up, origin[:-1], origin[1:]))
        # A gap in the item: the best of all earlier cells less their distance, as a running maximum.
        reach = np.maximum.accumulate(np.append(0, now) + steps)
        left = reach - steps
        gap = left[1:] > now
        if gap.any():
            source = np.maximum.accumulate(np.where(np.append(0, now) + steps == reach, np.arange(n + 1), 0))
            begin = np.where(gap, np.append(0, begin)[source[1:]], begin)
            now = np.maximum(now, left[1:])
        score, origin = np.append(0, now), np.append(0, begin)
        at = int(score.argmax())
        if score[at] > best:
            best, first, last = int(score[at]), int(origin[at]), at - 1
    return best, first, last


def best_scores(items: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """Smith-Waterman scores of items of one length (rows of word numbers) with a passage, side by side."""
    steps = np.arange(len(passage) + 1, dtype=np.int32) * OTHER
    score, best = np.zeros((len(items), len(passage) + 1), np.int32), np.zeros(len(items), np.int32)
    now = np.zeros_like(score)
    for k in range(items.shape[1]):
        diagonal = score[:, :-1] + np.where(items[:, k, None] == passage[None, :], np.int32(MATCH), np.int32(-OTHER))
        np.maximum(np.maximum(diagonal, score[:, 1:] - OTHER), 0, out=now[:, 1:])
        score = np.maximum.accumulate(now + steps, axis=1) - steps
        best = np.maximum(best, score.max(axis=1))
    return best


def _shared(items: Items) -> np.ndarray:
    """Of each n-gram, whether more than ``SHARED`` items have it."""
    return np.bincount(np.concatenate([*(np.unique(g) for g in items.gram_of), np.zeros(0, np.int64)]), minlength=len(items.grams)) > SHARED


def _led(g: np.ndarray, words: int, shared: np.ndarray) -> np.ndarray:
    """Which words of an item shared n-grams cover."""
    covered = np.zeros(words, bool)
    for j in range(min(NGRAM, words)):
        covered[j : j + len(g)] |= shared[g]
    return covered


class _Leads:
    """Items with a shared lead, by the n-grams of it and by their own words."""

    def __init__(self, items: Items, threshold: float):
        self.items, self.threshold = items, threshold
        self.shared = _shared(items)
        self.sizes = np.array([len(w) for w in items.words], np.int64)
        often = np.bincount(np.concatenate([*(np.unique(w) for w in items.words), np.zeros(0, np.int64)]), minlength=len(items.vocabulary))
        self.free = np.zeros(len(items.words), bool)  # of items that their lead alone may report
        own, owner, gram, holder = [], [], [], []
        for i, (g, w) in enumerate(zip(items.gram_of, items.words, strict=True)):
            covered = _led(g, len(w), self.shared)
            if not covered.any():
                continue
            spare = w[~covered]
            needed = int(np.ceil(threshold * len(w) - 1e-9)) - int(covered.sum())
            chosen = np.unique(spare[np.argsort(often[spare], kind="stable")][: len(spare) - needed + 1]) if needed > 0 else spare[:0]
            self.free[i] = needed <= 0
            own.append(chosen), owner.append(np.full(len(chosen), i))
            led = np.unique(g[self.shared[g]])
            gram.append(led), holder.append(np.full(len(led), i))
        none = np.zeros(0, np.int64)
        own, owner, gram, holder = (np.concatenate([none, *x]) for x in (own, owner, gram, holder))
        by = np.argsort(own, kind="stable")
        self.by_word, self.word_at = owner[by], np.searchsorted(own[by], np.arange(len(items.vocabulary) + 1))
        by = np.argsort(gram, kind="stable")
        self.by_gram, self.gram_at = holder[by], np.searchsorted(gram[by], np.arange(len(items.grams) + 1))
        # Words around an n-gram that the passage of any of its items can have.
        reach = np.zeros(len(items.grams), np.int64)
        np.maximum.at(reach, gram[by], self.sizes[self.by_gram] + _slack(self.sizes[self.by_gram]))
        self.reach = reach
        self.flat = np.concatenate([none, *items.words])
        self.begin = np.cumsum(self.sizes) - self.sizes

    def passages(self, w: np.ndarray, text: np.ndarray, grams: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, end) of passages around shared n-grams that may reach the threshold."""
        led = self.gram_at[grams + 1] > self.gram_at[grams]
        grams, at = grams[led], at[led]
        if not len(at):
            return []
        by = np.argsort(at, kind="stable")
        grams, at = grams[by], at[by]
        cuts = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])))
        first = np.searchsorted(text, np.arange(text[-1] + 2))
        out = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
            run, places, doc = grams[a:b], at[a:b], int(text[at[a]])
            lo, hi = first[doc], first[doc + 1]
            reach = int(self.reach[run].max())
            near = np.unique(w[max(lo, places[0] - reach) : min(hi, places[-1] + NGRAM + reach)])
            near = near[near >= 0]
            lead = np.unique(np.concatenate([self.by_gram[self.gram_at[g] : self.gram_at[g + 1]] for g in np.unique(run)]))
            some = np.unique(np.concatenate([np.zeros(0, np.int64), *(self.by_word[self.word_at[x] : self.word_at[x + 1]] for x in near.tolist())]))
            some = np.union1d(np.intersect1d(some, lead, assume_unique=True), lead[self.free[lead]])
            if not len(some):
                continue
            sizes = self.sizes[some]
            start = np.cumsum(sizes) - sizes
            there = np.isin(self.flat[np.repeat(self.begin[some] - start, sizes) + np.arange(sizes.sum())], near)
            some = some[np.add.reduceat(there, start) >= self.threshold * sizes - 1e-9]
            for i in self._reach(some, w[max(lo, places[0] - reach) : min(hi, places[-1] + NGRAM + reach)]):
                g, n = self.items.gram_of[i], len(self.items.words[i])
                begin = np.concatenate([p - np.flatnonzero(g == x) for x, p in zip(run.tolist(), places.tolist(), strict=True)])
                out += [(doc, i, max(int(lo), x - int(_slack(n))), min(int(hi), x + n + int(_slack(n)))) for x in np.unique(begin).tolist()]
        return out


    def _reach(self, some: np.ndarray, passage: np.ndarray) -> list[int]:
        """Those of ``some`` items whose score in the whole passage reaches the threshold."""
        out: list[int] = []
        sizes = self.sizes[some]
        for n in np.unique(sizes).tolist():
            alike = some[sizes == n]
            step = max(1, CELLS // (len(passage) + 1))
            for a in range(0, len(alike), step):
                part = alike[a : a + step]
                rows = self.flat[self.begin[part][:, None] + np.arange(n)]
                out += part[best_scores(rows, passage) >= self.threshold * MATCH * n - 1e-9].tolist()
        return out


def _slack(size: np.ndarray | int) -> np.ndarray | int:
    """Words that a passage may be longer than its item, at either end."""
    return size // 2 + 4


class Aligner:
    """Seeds and alignments for a block of items, with a bounded memory of passages.

    ``seeds`` has, for each item, the places whose n-grams are its seeds.
    """

    def __init__(self, items: Items, seeds: list[np.ndarray], threshold: float):
        self.items, self.threshold, self.known = items, threshold, {}
        self.leads, self.aligned = _Leads(items, threshold), 0
        owner = np.concatenate([np.full(len(p), i) for i, p in enumerate(seeds)] + [np.zeros(0, np.int64)]).astype(np.int64)
        place = np.concatenate([*seeds, np.zeros(0, np.int64)]).astype(np.int64)
        gram = np.concatenate([*(g[p] for g, p in zip(items.gram_of, seeds, strict=True)), np.zeros(0, np.int64)])
        order = np.argsort(gram, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.start = np.searchsorted(gram[order], np.arange(len(items.grams) + 1))

    def _score(self, i: int, passage: np.ndarray) -> tuple[int, int, int]:
        name = (i, passage.tobytes())
        got = self.known.get(name)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[name] = align(self.items.words[i], passage)
            self.aligned += 1
        return got

    def hits(self, part: pa.Array) -> list[list[dict]]:
        """For each text, its items at or above the threshold with their best passage."""
        out: list[list[dict]] = [[] for _ in range(len(part))]
        w, text, grams, at = _found(self.items, part)
        led = self.leads.passages(w, text, grams, at)
        seeded = self.start[grams + 1] > self.start[grams]
        grams, at = grams[seeded], at[seeded]
        if not len(at) and not led:
            return out
        many = self.start[grams + 1] - self.start[grams]
        row = np.repeat(np.arange(len(at)), many)
        entry = self.start[grams][row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]
        item, begin = self.owner[entry], at[row] - self.place[entry]
        sizes = self.leads.sizes
        slack = _slack(sizes[item])
        first = np.searchsorted(text, np.arange(len(part) + 1))
        doc = text[at[row]]
        lo, hi = np.maximum(first[doc], begin - slack), np.minimum(first[doc + 1], begin + sizes[item] + slack)
        doc, item, lo, hi = (np.append(x, np.array([p[k] for p in led], np.int64)) for k, x in enumerate((doc, item, lo, hi)))
        order = np.lexsort((lo, item, doc))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        a = 0
        while a < len(order):
            k = order[a]
            d, i, low, high = int(doc[k]), int(item[k]), int(lo[k]), int(hi[k])
            a += 1
            while a < len(order) and doc[order[a]] == d and item[order[a]] == i and lo[order[a]] <= high:
                high = max(high, int(hi[order[a]]))
                a += 1
            score, s, e = self._score(i, w[low:high])
            share = score / (MATCH * sizes[i])
            if share >= self.threshold and share > best.get((d, i), (0.0,))[0]:
                best[d, i] = (share, low + s - int(first[d]), low + e - int(first[d]))
        for (d, i), (share, s, e) in sorted(best.items()):
            out[d] += [{"item_id": k, "score": share, "first_word": s, "last_word": e} for k in self.items.ids[i]]
        return out


def item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Items]:
    """Test items in blocks of at most ``MOST_BLOCK_BYTES`` of text (one item at least)."""
    rows = benchmark.filter(F.col(item).isNotNull() & (F.length(text) > 0)).select(F.col(item).cast("long").alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // MOST_BLOCK_BYTES))
    for b in range(blocks):
        here = (rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)).collect()
        here = sorted(here)
        if here:
            yield Items.build([r["i"] for r in here], [r["t"] for r in here])


def seeds(docs: DataFrame, text: str, items: Items, rare: float = RARE) -> list[np.ndarray]:
    """For each item, the places of its seeds: rare n-grams, and the rarest of every few neighbours."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(items.grams), np.int64), 0
        for batch in batches:
            n += len(batch)
            for part in features.parts(batch.column(0)):
                _, of, grams, at = _found(items, part)
                once = np.unique(of[at] * len(items.grams) + grams) if len(at) else np.zeros(0, np.int64)
                total += np.bincount(once % max(1, len(items.grams)), minlength=len(items.grams))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], n))], ["gram", "n"])

    counts = np.zeros(len(items.grams) + 1, np.int64)
    for r in docs.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["gram"]] = r["n"]
    rare_ones = counts[:-1] <= max(FEW, rare * counts[-1])
    shared = _shared(items)
    return [_places(g, counts, rare_ones, shared) for g in items.gram_of]


def _places(g: np.ndarray, counts: np.ndarray, rare: np.ndarray, shared: np.ndarray) -> np.ndarray:
    alone = ~shared[g]
    chosen = rare[g] & alone
    for at in range(0, len(g), SPACING):
        near = at + np.flatnonzero(alone[at : at + SPACING])
        if len(near):
            chosen[near[counts[g[near]].argmin()]] = True
    return np.flatnonzero(chosen)


def with_hits(docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, name: str = "hits", threshold: float = THRESHOLD, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) and an array of benchmark hits in column ``name``."""
    kept = tuple(docs.columns if keep is None else keep)
    schema = T.StructType([T.StructField("__text", T.StringType()), *features.schema(docs, kept, f"`{name}` {HIT}").fields])
    out = docs.select(F.col(text).alias("__text"), *kept).withColumn(name, F.array().cast(HIT))
    for items in item_blocks(benchmark, item, item_text):
        chosen = seeds(docs, text, items)

        def find(batches: Iterator[pa.RecordBatch], items: Items = items, chosen: list[np.ndarray] = chosen) -> Iterator[pa.RecordBatch]:
            aligner = Aligner(items, chosen, threshold)
            for batch in batches:
                hits = [a + b for a, b in zip((h for part in features.parts(batch.column(0)) for h in aligner.hits(part)), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, _HIT)], batch.schema.names)

        out = out.mapInArrow(find, schema)
    return out.drop("__text")


def contaminated(docs: DataFrame, key: str, text: str, benchmark: DataFrame, item: str, item_text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, item_id, score, first_word, last_word): every document and test item that align."""
    hits = with_hits(docs, text, benchmark, item, item_text, "hits", threshold, (key,))
    return hits.filter(F.size("hits") > 0).select(key, F.explode("hits").alias("h")).select(key, "h.*")
