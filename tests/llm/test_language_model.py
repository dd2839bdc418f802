import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import language_model as lm


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


class Sequential:
    """The automaton with explicit states, arcs and failure arcs, read word by word."""

    def __init__(self, texts, mu):
        self.mu, self.order = mu, len(mu) + 1
        self.grams = Counter()
        for t in texts:
            seq = ["<s>", *tokens(t)]
            for k in range(1, self.order + 1):
                for i in range(max(1, k - 1), len(seq)):
                    self.grams[tuple(seq[i - k + 1 : i + 1])] += 1
        self.starts = len(texts)
        self.n = sum(c for g, c in self.grams.items() if len(g) == 1)
        self.v = sum(1 for g in self.grams if len(g) == 1)

    def left(self, state):
        return self.starts if state == ("<s>",) else self.grams[state]

    def base(self, word):
        return math.log10((self.grams[word,] + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def log_p(self, state, word):
        if not state:
            return self.base(word)
        mu, count = self.mu[len(state) - 1], self.left(state)
        if self.grams[(*state, word)]:
            return math.log10((self.grams[(*state, word)] + mu * 10 ** self.log_p(state[1:], word)) / (count + mu))
        return math.log10(mu / (count + mu)) + self.log_p(state[1:], word)

    def score(self, text):
        state, total = ("<s>",) if self.starts else (), 0.0
        for word in tokens(text):
            total += self.log_p(state, word)
            state = (*state, word)[-(self.order - 1) :]
            while state and not self.left(state):
                state = state[1:]
        return total


ROWS = [(1, "The cat sat on the mat"), (2, "the cat SAT on\tthe hat"), (3, "a dog sat on the cat\x0b"), (4, "the dog"), (5, None), (6, ""), (7, "the cat sat on the mat"), (8, "é É the cat unseen words"), (None, "no key here"), (9, "x " * 3000), (1, "The cat sat on the mat")]


@pytest.mark.parametrize("mu", [(4.0,), (4.0, 2.0)])
def test_equals_the_sequential_automaton(spark, mu):
    df = spark.createDataFrame([(*r, "u") for r in ROWS], "doc_id long, text string, score string")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 3 == 0
    model = Sequential([t for k, t in ROWS if not held(k)], mu)
    got = lm.score(df, "doc_id", "text", train, mu=mu, block_bytes=600).collect()
    assert len(got) == len(ROWS)
    want = sorted((str(k), held(k), len(tokens(t)), sum(model.grams[w,] > 0 for w in tokens(t)), model.n, round(sum(map(model.base, tokens(t))), 6), round(model.score(t), 6)) for k, t in ROWS)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_probabilities_sum_to_one():
    model = Sequential([t for _, t in ROWS], (4.0,))
    words = [g[0] for g in model.grams if len(g) == 1] + ["<unseen>"]
    for state in [("<s>",), ("the",), ("cat",), ("x",)]:
        assert sum(10 ** model.log_p(state, w) for w in words) == pytest.approx(1)


def test_no_training_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score(df, "doc_id", "text", F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert lm.score(df.limit(0), "doc_id", "text", F.lit(True)).count() == 0


def test_repeated_text_scores_above_base_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    r = lm.score(docs, "doc_id", "text", train).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_registered_model_has_contexts_of_two_words(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    model = Sequential([t for _, t in ROWS], (128.0, 128.0))
    got = sorted((str(r.doc_id), r.score) for r in lm.score(df, "doc_id", "text", F.lit(True)).collect())
    want = sorted((str(k), model.score(t)) for k, t in ROWS)
    assert [k for k, _ in got] == [k for k, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want])


def block(texts, mu):
    """The automaton of one block that has the whole corpus, its sequence and its words by position."""
    seq, levels = lm.read(pa.array(texts)), []
    for at, h in lm.grams(seq, len(mu) + 1):
        known, total, back = lm._training_counts(h, np.ones(len(h)))
        here = np.full(len(seq.hashes), -1, np.int64)
        here[at] = back
        levels.append(lm.Level(total, here))
    n = levels[0].count
    return lm.Automaton(seq, levels, int(n.sum()), int((n > 0).sum()), len(texts), mu), seq, levels[0].at


@pytest.mark.parametrize("mu", [(4.0,), (4.0, 2.0), (4.0, 2.0, 3.0)])
@pytest.mark.parametrize("piece", [4, 7, 256])
def test_a_walk_in_pieces_equals_one_walk(mu, piece):
    texts = [t or "" for _, t in ROWS]
    automaton, seq, word = block(texts, mu)
    model, got = Sequential(texts, mu), automaton.walk(seq, word, piece)
    for i, t in enumerate(texts):
        assert got[seq.text == i].sum() == pytest.approx(model.score(t))


def test_states_fail_to_shorter_ones_and_arcs_are_the_ngrams_seen():
    texts = ["a b a b c", "b a b", ""]
    automaton, seq, word = block(texts, (4.0, 2.0))
    grams = Sequential(texts, (4.0, 2.0)).grams
    assert len(automaton.key) == sum(len(g) > 1 for g in grams)
    states = {g for g in grams if len(g) < 3} | {("<s>",)}
    assert len(automaton.left) == 1 + len(states)
    for s in range(len(automaton.left)):  # failure arcs end at the root
        steps = 0
        while s:
            s, steps = automaton.fail[s], steps + 1
        assert steps <= 2


def test_a_long_text_among_short_ones(spark):
    rows = [(1, "w1 w2 w3 " * 20_000), (2, "w1 w2"), (3, None)]
    model = Sequential([t for _, t in rows], (128.0, 128.0))
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", F.lit(True)).collect()}
    assert got == pytest.approx({k: model.score(t) for k, t in rows})
