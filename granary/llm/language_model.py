"""Language-model scoring by a weighted backoff automaton.

Model: word n-grams with Dirichlet-smoothed backoff.  The unigram level is the base
distribution (count + 0.1) / (N + 0.1 (V + 1)); at each higher order

    p(w | context) = (count(context w) + mu p(w | shorter context)) / (count(context) + mu)

which sums to one.  As an automaton: every context seen in training is a state; every
n-gram seen is an arc that carries log10 p; a state's failure arc carries
log10(mu / (count(context) + mu)) and leads to the state of the shorter context, down to
the root, whose arcs are the base distribution.  A text is read once from left to right:
each word follows failure arcs until an arc for it exists, adds their weights, and moves to
the longest context that the automaton has.

The automaton of a whole corpus has no size bound, so it is never gathered.  Each block of
documents gets the sub-automaton its own texts can visit (see ``blocks``): exact corpus-wide
counts of the n-grams and contexts that occur in it.  A block sends the hashes and counts of
its distinct n-grams; the answer is what other blocks add to each count, in the order in which
they were sent, so hashes travel once, with all their 64 bits.  From the counts a block makes a
table of states, one of arcs and one of failure arcs, and walks them.  Nothing is capped or
pruned; what is exchanged grows in proportion to the corpus.

Texts are walked side by side.  A long one is walked in pieces of ``PIECE`` words; as a state is
the longest known context, reading the words of one context from the root leads to the state in
which the piece before ends.

Defined results: words are runs of bytes other than ASCII white space, A-Z lower-cased;
null and empty texts are one end token; rows with a null key are trained on; repeated rows
count each time; without training rows every word has base probability 1 / (V + 1) with
V = 0; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import blocks as exchange
from granary.llm.features import mix

BLOCK_BYTES = 8 << 20
#: Words of a text that are walked from one start.
PIECE = 256
#: Weight of the shorter context, from order 2 up.
MU = (128.0, 128.0)
ADDED = 0.1
#: Hashes of the marks around a text; words get the XXH64 of their bytes.
START, END = np.uint64(1), np.uint64(2)


@dataclass
class Sequence:
    """All texts of a block as one row of words: start mark, words, end mark, next text."""

    hashes: np.ndarray
    text: np.ndarray
    scored: np.ndarray
    place: np.ndarray


def read(texts: pa.Array) -> Sequence:
    """Words of whole texts as 64-bit hashes."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    flat, offsets = lists.values, lists.offsets.to_numpy()
    flat = flat.slice(offsets[0], offsets[-1] - offsets[0])
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    full = pc.greater(pc.binary_length(flat), 0)
    of, flat = of[full.to_numpy(zero_copy_only=False)], flat.filter(full)
    coded = flat.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    known = np.fromiter((digest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    counts = np.bincount(of, minlength=len(texts))
    begin = np.cumsum(counts + 2) - (counts + 2)
    h = np.full(int((counts + 2).sum()), END, np.uint64)
    h[begin] = START
    within = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
    h[begin[of] + 1 + within] = known[coded.indices.to_numpy()] if len(of) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(texts)), counts + 2)
    place = np.arange(len(h)) - begin[text]
    return Sequence(h, text, place > 0, place)


def grams(seq: Sequence, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, (position of the last word, hash of the n-gram) of every n-gram."""
    out, h = [(np.flatnonzero(seq.scored), seq.hashes[seq.scored])], seq.hashes
    for k in range(2, order + 1):
        longer = np.zeros_like(h)
        longer[1:] = mix(h[:-1] * np.uint64(0xA24BAED4963EE407) + seq.hashes[1:] + np.uint64(k))
        at = np.flatnonzero(seq.place >= k - 1)
        out.append((at, longer[at]))
        h = longer
    return out


@dataclass
class Level:
    """Distinct n-grams of one order in a block: training counts, and the index of the one that ends at each position (-1: none)."""

    count: np.ndarray
    at: np.ndarray

    def example(self) -> np.ndarray:
        """A position where each n-gram ends."""
        out = np.zeros(len(self.count), np.int64)
        here = np.flatnonzero(self.at >= 0)
        out[self.at[here]] = here
        return out


class Automaton:
    """The part of the automaton that a block's texts can visit.

    State 0 is the root.  ``left``, ``fail`` and ``fail_weight`` say of each state how often
    training left it, where its failure arc leads and what that weighs.  Arcs are sorted by
    ``key`` (state and word) with their ``weight`` and ``target``; the root has an arc for every
    word, in ``root_weight`` and ``root_target``.
    """

    def __init__(self, seq: Sequence, levels: list[Level], tokens: int, words: int, texts: int, mu: tuple[float, ...]):
        self.order, self.words = len(levels), len(levels[0].count)
        self.base = np.log10((levels[0].count + ADDED) / (tokens + ADDED * (words + 1)))
        # Contexts by level: an n-gram of training is a state unless it is as long as the order; the mark of a text's start is one.
        counts = [np.append(levels[0].count, texts), *(x.count for x in levels[1:-1])] if self.order > 1 else []
        state, n = [], 1
        for c in counts:
            known = c > 0
            state.append(np.where(known, n + np.cumsum(known) - 1, 0))
            n += int(known.sum())
        self.left, self.fail, self.fail_weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        self.start = int(state[0][-1]) if state else 0
        before = np.where(seq.place == 0, self.words, levels[0].at)  # the context of one word that ends at each position
        ends = [before, *(x.at for x in levels[1:-1])]
        for k, c in enumerate(counts):
            on = state[k] > 0
            self.left[state[k][on]] = c[on]
            self.fail_weight[state[k][on]] = np.log10(mu[k] / (c[on] + mu[k]))
            if k:
                shorter = state[k - 1][ends[k - 1][levels[k].example()]]
                self.fail[state[k][on]] = shorter[on]
        self.root_weight, self.root_target = self.base, state[0][:-1] if state else np.zeros(self.words, np.int64)
        log_p, keys, weights, targets = self.base, [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for k in range(1, self.order):
            example, c = levels[k].example(), levels[k].count
            source = state[k - 1][ends[k - 1][example - 1]]
            shorter = log_p[levels[k - 1].at[example]]
            left, m = self.left[source], mu[k - 1]
            seen = c > 0
            log_p = np.where(source > 0, np.where(seen, np.log10((c + m * 10.0**shorter) / np.maximum(left + m, 1)), self.fail_weight[source] + shorter), shorter)
            follow = state[k] if k < self.order - 1 else state[k - 1][ends[k - 1][example]]
            keys.append((source * self.words + levels[0].at[example])[seen]), weights.append(log_p[seen]), targets.append(follow[seen])
        key = np.concatenate(keys)
        by = np.argsort(key)
        self.key, self.weight, self.target = key[by], np.concatenate(weights)[by], np.concatenate(targets)[by]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, next state) of reading one word in each of many states: failure arcs until there is an arc."""
        total, state = np.zeros(len(word)), state.copy()
        after, open_ = np.zeros(len(word), np.int64), np.arange(len(word))
        for _ in range(self.order):
            root = state[open_] == 0
            done = open_[root]
            total[done] += self.root_weight[word[done]]
            after[done] = self.root_target[word[done]]
            open_ = open_[~root]
            if not len(open_):
                break
            key = state[open_] * self.words + word[open_]
            at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
            arc = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
            done = open_[arc]
            total[done] += self.weight[at[arc]]
            after[done] = self.target[at[arc]]
            open_ = open_[~arc]
            total[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail[state[open_]]
        return total, after

    def walk(self, seq: Sequence, word: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """log10 probability of each position of ``seq`` (0 for start marks); ``word`` has the word at each position."""
        out = np.zeros(len(word))
        starts = np.flatnonzero(seq.place == 0)
        sizes = np.diff(np.append(starts, len(word))) - 1
        many = -(-sizes // piece)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first = np.repeat(starts + 1, many) + nth * piece
        size = np.minimum(np.repeat(sizes, many) - nth * piece, piece)
        by = np.argsort(-size, kind="stable")
        first, size, nth = first[by], size[by], nth[by]
        state = np.where(nth == 0, self.start, 0)
        later = np.flatnonzero(nth > 0)
        for back in range(self.order - 1, 0, -1):  # pieces are longer than a context, so this reads words of the piece before
            _, state[later] = self.step(state[later], word[first[later] - back])
        for t in range(int(size.max(initial=0))):
            on = int(np.searchsorted(-size, -t, "left"))  # pieces with more than t words
            here = first[:on] + t
            out[here], state[:on] = self.step(state[:on], word[here])
        return out


def _training_counts(hashes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, their training counts, index of each hash among them)."""
    known, back = np.unique(hashes, return_inverse=True)
    return known, np.bincount(back, train, minlength=len(known)).astype(np.int64), back


_SENT = "part int, block int, texts long, grams array<binary>, counts array<binary>"
_BACK = "block int, part int, tokens long, words long, texts long, added array<binary>"


def score(df: DataFrame, key: str, text: str, train: Column, mu: tuple[float, ...] = MU, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    The model learns from rows where ``train`` is true; its order is one more than the
    number of weights ``mu``.
    """
    order = len(mu) + 1
    dealt, n, _, opened = exchange.deal(df, key, text, block_bytes, train=F.coalesce(train, F.lit(True)))
    binaries = pa.list_(pa.binary())

    def send(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        table = opened(table)
        seq = read(table["text"].combine_chunks())
        learned = table["train"].combine_chunks().to_numpy(zero_copy_only=False)
        found = [_training_counts(h, learned[seq.text[at]])[:2] for at, h in grams(seq, order)]
        cuts = [exchange.range_cuts(h, n) for h, _ in found]
        rows = [[], []]
        for p in range(n):
            rows[0].append([exchange.pack_sorted(h[c[p] : c[p + 1]]) for (h, _), c in zip(found, cuts, strict=True)])
            rows[1].append([exchange.pack(m[c[p] : c[p + 1]]) for (_, m), c in zip(found, cuts, strict=True)])
        texts = np.zeros(n, np.int64)
        texts[0] = learned.sum()
        return pa.table({"part": pa.array(np.arange(n, dtype=np.int32)), "block": pa.array(np.full(n, block, np.int32)), "texts": pa.array(texts), "grams": pa.array(rows[0], binaries), "counts": pa.array(rows[1], binaries)})

    def merge(table: pa.Table) -> pa.Table:
        added: list[list[bytes]] = [[] for _ in range(table.num_rows)]
        tokens = words = 0
        for k in range(order):
            sent = [exchange.unpack_sorted(g[k].as_py()) for g in table["grams"]]
            ends = np.cumsum([len(s) for s in sent])
            own = np.concatenate([exchange.unpack(c[k].as_py()) for c in table["counts"]])
            h = np.concatenate(sent)
            del sent
            by = np.argsort(h, kind="stable")
            h, own = h[by], own[by]
            first = exchange.first_of_runs(h)
            total = np.add.reduceat(own, first) if len(first) else own
            if not k:
                tokens, words = int(total.sum()), int((total > 0).sum())
            more = np.empty_like(own)
            more[by] = np.repeat(total, np.diff(np.append(first, len(h)))) - own  # what others add, in the order in which each block sent
            for to, mine in zip(added, np.split(more, ends[:-1]), strict=True):
                to.append(exchange.pack(mine))
        rows = table.num_rows
        same = lambda x: pa.array(np.full(rows, x, np.int64))
        texts = int(pc.sum(table["texts"]).as_py())
        return pa.table({"block": table["block"], "part": table["part"], "tokens": same(tokens), "words": same(words), "texts": same(texts), "added": pa.array(added, binaries)})

    def apply(table: pa.Table, facts: pa.Table) -> pa.Table:
        table = opened(table)
        seq = read(table["text"].combine_chunks())
        learned = table["train"].combine_chunks().to_numpy(zero_copy_only=False)
        parts = facts["part"].to_pylist()
        levels = []
        for k, (at, h) in enumerate(grams(seq, order)):
            known, total, back = _training_counts(h, learned[seq.text[at]])
            cuts = exchange.range_cuts(known, n)
            for p, added in zip(parts, facts["added"], strict=True):
                total[cuts[p] : cuts[p + 1]] += exchange.unpack(added[k].as_py())
            here = np.full(len(seq.hashes), -1, np.int64)
            here[at] = back
            levels.append(Level(total, here))
        tokens, words, texts = (int(pc.sum(facts[c]).as_py() or 0) for c in ("tokens", "words", "texts"))
        automaton = Automaton(seq, levels, tokens, words, texts, mu)
        word = levels[0].at
        p, base = automaton.walk(seq, word), np.where(seq.scored, automaton.base[word], 0.0)
        known = np.where(seq.scored, levels[0].count[word] > 0, 0)
        rows, first = table.num_rows, np.flatnonzero(seq.place == 0)
        exact = lambda v: np.add.reduceat(v.astype(np.longdouble), first).astype(np.float64)
        return pa.table({
            key: table["key"], "held_out": pc.invert(table["train"]), "n_tokens": pa.array(np.bincount(seq.text[seq.scored], minlength=rows)),
            "n_known": pa.array(np.add.reduceat(known, first)), "train_tokens": pa.array(np.full(rows, tokens)),
            "base_score": pa.array(exact(base)), "score": pa.array(exact(p)),
        })

    sent = dealt.groupBy("block").applyInArrow(send, _SENT)
    facts = exchange.to_owner(sent, "part", n).groupBy("part").applyInArrow(merge, _BACK)
    name = dict(df.dtypes)[key]
    schema = f"`{key}` {name}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            empty = {key: opened(left)["key"], "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, **{c: pa.array([], pa.float64()) for c in ("base_score", "score")}}
            return pa.table(empty)
        return apply(left, right)

    return dealt.groupBy("block").cogroup(exchange.to_owner(facts, "block", n).groupBy("block")).applyInArrow(visit, schema)
