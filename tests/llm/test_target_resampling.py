"""Resampling against a plain count of strings, and its defined results."""

import hashlib
import math
import re
import zlib
from collections import Counter

from granary.llm import target_resampling as t


def read(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def features(text, longest=2, buckets=10_000):
    w = read(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target):
    s, goal = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        goal.update(features(text))
    all_s, all_t = sum(s.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for key, text in docs:
        f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(read(text)) >= 20])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2]))
    out = [(*r[:4], None) for r in rows if not r[4]]
    return sorted(out + [(*r[:4], k + 1 if k < 25 * len(able) // 100 else None) for k, r in enumerate(able)], key=repr)


def test_equals_brute_force_with_nulls_ties_and_repeats(spark):
    base = [(i, f"Alpha{i % 7} beta, gamma-delta {i} " * (i % 9) + "Ünder\tone") for i in range(60)]
    docs = [*base, (3, base[3][1]), (8, base[8][1]), (8, base[8][1]), (None, base[17][1]), (None, base[17][1]), (None, base[26][1]), (100, None), (101, ""), (102, "!?"), (103, "long words " * 70_000)]
    target = ["beta gamma delta", None, "", "words of the target", "words of the target"]
    got = t.resample(spark.createDataFrame(docs, "id long, body string").repartition(3), "id", "body", spark.createDataFrame([(x,) for x in target], "rank string"), "rank")
    assert got.columns == ["id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target)


def test_ring_reads_on_between_steps_and_takes_any_length():
    words, out, states = [b"a", b"bc", b"d", b"ef", b"a"], [], []
    for w in words:
        out += t.ring([w], 3, states)
    assert out == list(t.ring(words, 3))
    assert Counter(x % 10_000 for x in out) == Counter(features("a bc d ef a", 3))


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "one two " * 20)], "k long, text string"), spark.createDataFrame([], "text string")
    assert t.resample(docs.limit(0), "k", "text", none, "text").collect() == []
    assert [tuple(r) for r in t.resample(docs, "k", "text", none, "text").collect()] == brute([(1, "one two " * 20)], [])
