import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import features, quality


def test_tokens_against_a_plain_scan():
    texts = ["", "Hello, wörld!!", None, "a_b c-d\t\n##", "x", "  lead", "Same same SAME"]
    h, of = features.tokens(pa.array(texts).fill_null(""))

    def plain(t):
        out, kind = [], None
        for c in t or "":
            k = None if c.isspace() else (c.isalnum() or c == "_" or ord(c) > 127)
            if k is None:
                kind = None
                continue
            if k == kind:
                out[-1] += c
            else:
                out.append(c)
            kind = k
        return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in out]

    words = [(i, w) for i, t in enumerate(texts) for w in plain(t)]
    assert of.tolist() == [i for i, _ in words]
    seen = {}
    for (_, w), x in zip(words, h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    only, _ = features.tokens(pa.array(["a, b!"]), marks=False)
    assert len(only) == 2
    sliced, of2 = features.tokens(pa.array(texts).fill_null("").slice(3, 2))
    assert sliced.tolist() == [x for x, i in zip(h.tolist(), of.tolist(), strict=True) if i in (3, 4)] and set(of2.tolist()) == {0, 1}


def test_weights_against_brute_force(spark):
    good = ["the cat sat on the mat", "a dog ran", "the cat ran home"] * 5
    bad = ["buy!!! now!!! $$$", "win win win win"] * 3
    rows = [(i, t, "c") for i, t in enumerate(good + bad + [None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, selected string")
    labels = spark.createDataFrame([(i, 1) for i in range(len(good))] + [(99, 1), (0, 1), (None, 1)] + [(len(good), 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.resample(docs, labels, "doc_id", "text", F.col("quality") == 1).collect()}
    ids = [Counter(quality._ids(pa.array([t or ""]))[0].tolist()) for _, t, _ in rows]
    raw, target = sum(ids, Counter()), sum(ids[: len(good)], Counter())
    n, m, b = sum(raw.values()), sum(target.values()), quality.BUCKETS
    for (i, _, _), counts in zip(rows, ids, strict=True):
        want = 0.0
        for k, c in counts.items():
            r = (raw[k] + quality.SMOOTHING) / (n + quality.SMOOTHING * b)
            t = (target[k] + quality.PRIOR * r * b) / (m + quality.PRIOR * b)
            want += c * max(-quality.CLIP, min(quality.CLIP, math.log(t / r)))
        assert got[i].log_weight == pytest.approx(want)
    k = round(sum(min(1, math.exp(min(0, r.log_weight - quality.SLACK))) for r in got.values()))
    ranked = sorted((r.gumbel_key for r in got.values()), reverse=True)
    assert sum(r.selected for r in got.values()) == k and all(r.selected == (r.gumbel_key >= ranked[k - 1]) for r in got.values())


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    values = [*rng.normal(size=300), *[0.25] * 50, *rng.normal(size=200) * 1e-12]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for least in (4096, 8):
        quality.LAST_RANGE = least
        try:
            for k in (1, 2, 100, 275, 549, 550):
                assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
        finally:
            quality.LAST_RANGE = 4096
    assert quality.kth_largest(df, "v", 0) is None and quality.kth_largest(df.limit(0), "v", 3) is None


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, "w " * 20_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.resample(docs, none, "doc_id", "text", F.col("quality") == 1).collect()
    assert len(got) == 5 and all(r.selected and r.log_weight == 0 for r in got)
    assert quality.resample(docs.limit(0), none, "doc_id", "text", F.col("quality") == 1).count() == 0
    kept = quality.resample(docs, none, "doc_id", "text", F.col("quality") == 1, keep=("text", "doc_id"))
    assert kept.columns[:2] == ["text", "doc_id"]


def test_labelled_accuracy(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.resample(docs, labels, "doc_id", "text", F.col("quality") == 1).join(labels, "doc_id").collect()
    good = [r.selected for r in rows if r.quality == 1]
    bad = [r.selected for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.15


def test_accuracy_on_labels_that_were_not_learned_and_a_given_k(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    learned = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    got = quality.resample(docs, learned, "doc_id", "text", F.col("quality") == 1)
    rows = got.join(labels.join(learned, "doc_id", "left_anti"), "doc_id").collect()
    good, bad = ([r.selected for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 1000 and sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1
    assert quality.resample(docs, learned, "doc_id", "text", F.col("quality") == 1, k=100).filter("selected").count() == 100
