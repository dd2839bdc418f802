"""Packed store, range decode and window draws against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import sampling, store, windows


def catalog(spark, chunk, seed=3):
    rng = random.Random(seed)
    rows = {s: ["".join(rng.choice("ACGTacgt" if rng.random() > 0.02 else "NRx") for _ in range(rng.choice([0, 5, 40, 333]))) for _ in range(4)] for s in ("a", "b", "c")}
    rows["d"] = ["", ""]
    chunks = [(s, r, k, t[k * chunk : (k + 1) * chunk]) for s, rs in rows.items() for r, t in enumerate(rs) for k in range(max(1, -(-len(t) // chunk)))]
    return rows, store.placed(spark.createDataFrame(chunks, "source string, record int, chunk int, symbols string").repartition(3), "source", "record", "chunk", "symbols")


def plain(text):
    return "".join(c if c in "ACGT" else "A" for c in text.upper())


@pytest.mark.parametrize(("chunk", "block"), [(1, 4), (7, 16), (50, 7), (1000, 64), (64, 1 << 16)])
def test_any_range_decodes_to_its_text(spark, chunk, block):
    rows, placed = catalog(spark, chunk)
    whole = {s: plain("".join(rs)) for s, rs in rows.items()}
    blocks = store.blocks(placed, "source", "symbols", block)
    rng = random.Random(5)
    asked = [(s, rng.randrange(n), rng.randrange(1, 120)) for s, t in whole.items() if (n := len(t)) for _ in range(25)] + [("a", 0, len(whole["a"])), ("a", 3, 4), ("a", 3, 4), ("z", 0, 1), ("d", 0, 1), ("a", -1, 2), (None, 1, 1)]
    got = store.decode(blocks, spark.createDataFrame(asked, "source string, start long, length int"), "source", "start", "length", "bases", block).collect()
    assert len(got) == len(asked)
    for r in got:
        t = whole.get(r.source, "")
        assert r.bases == (t[r.start : r.start + r.length] if 0 <= r.start and r.start + r.length <= len(t) else None)
    sizes = {r.source: r.n for r in blocks.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    assert sizes == {s: len(t) for s, t in whole.items() if t}


@pytest.mark.parametrize("chunk", [1, 9, 1000])
def test_contigs_and_callable_intervals(spark, chunk):
    rows, placed = catalog(spark, chunk)
    want, spans = set(), set()
    for s, rs in rows.items():
        at = 0
        for r, t in enumerate(rs):
            want.add((s, r, at, len(t)))
            good = [c in "ACGTacgt" for c in t] + [False]
            low = None
            for i, g in enumerate(good):
                if g and low is None:
                    low = i
                if not g and low is not None:
                    spans.add((s, r, at + low, at + i))
                    low = None
            at += len(t)
    assert {tuple(r) for r in store.contigs(placed, "source", "record", "symbols").collect()} == want
    assert {(r.source, r.record, r.start, r.end) for r in store.callable_intervals(placed, "source", "record", "symbols").collect()} == spans


def test_draws_equal_those_of_a_list(spark, monkeypatch):
    monkeypatch.setattr(windows, "BAND", 7)
    rng = np.random.default_rng(4)
    rows = [(f"s{i:04}", float(rng.integers(0, 5)), "train" if i % 3 else "held") for i in range(300)]
    spans = [(name, int(1000 * k), int(rng.integers(1, 60))) for name, _, _ in rows for k in range(int(rng.integers(0, 25)))]
    sources, intervals = spark.createDataFrame(rows, "source string, weight double, split string"), spark.createDataFrame(spans, "source string, start long, length long")
    steps = spark.createDataFrame([(s, r) for s in range(12) for r in range(3)], "step long, rank long")
    listed = [{"name": n, "weight": w, "intervals": [(a, k) for s, a, k in spans if s == n]} for n, w, split in rows if split == "train"]
    release = sampling.Release(listed, 20)
    want = sorted(d for s in range(12) for r in range(3) for d in release.draws(9, s, r, 5))
    got = windows.draw(steps, windows.tables(sources, intervals, 20, split="train"), 9, 5)
    assert sorted(tuple(r) for r in got.collect()) == want
    declared = intervals.filter("length >= 20").groupBy("source").agg(F.sum(F.floor(F.col("length") / 20)).alias("windows"))
    windows.tables(sources, intervals, 20, split="train", declared=declared)
    with pytest.raises(ValueError, match="capacity"):
        windows.tables(sources, intervals, 20, split="train", declared=declared.withColumn("windows", F.col("windows") + 1))
    with pytest.raises(ValueError, match="no source"):
        windows.tables(sources, intervals, 100)


def test_many_sources_draw_as_a_list_does(spark):
    n = 100_000
    sources = spark.range(n).select(F.format_string("s%06d", "id").alias("source"), (F.col("id") % 7).cast("double").alias("weight"))
    intervals = sources.select("source", F.lit(5).alias("start"), (F.lit(30) + F.crc32(F.col("source").cast("binary")) % 9).alias("length"))
    listed = [{"name": r.source, "weight": r.weight, "intervals": [(r.start, r.length)]} for r in sources.join(intervals, "source").orderBy("source").collect()]
    release = sampling.Release(listed, 30)
    steps = spark.range(200).select(F.col("id").alias("step"), F.lit(1).alias("rank"))
    got = windows.draw(steps, windows.tables(sources, intervals, 30), 2, 2).collect()
    assert sorted(tuple(r) for r in got) == sorted(d for s in range(200) for d in release.draws(2, s, 1, 2))


def test_sampled_windows_are_the_symbols_of_their_places(spark):
    rows, placed = catalog(spark, 50)
    blocks = store.blocks(placed, "source", "symbols", 32)
    spans = store.callable_intervals(placed, "source", "record", "symbols").select("source", "start", (F.col("end") - F.col("start")).alias("length"))
    sources = spark.createDataFrame([(s, 1.0) for s in rows], "source string, weight double")
    steps = spark.range(20).select(F.col("id").alias("step"), F.lit(0).alias("rank"))
    got = windows.sample(steps, windows.tables(sources, spans, 12), blocks, 12, 7, 3, 32).collect()
    assert len(got) == 60
    for r in got:
        text = "".join(rows[r.source])[r.start : r.start + 12].upper()
        assert set(text) <= set("ACGT")
        text = text.translate(str.maketrans("ACGT", "TGCA"))[::-1] if r.reverse else text
        assert r.bases == text and list(r.ids) == ["ACGT".index(c) + 2 for c in text]


def test_a_draw_looks_at_one_band_a_level(spark, monkeypatch):
    """no row has the heads of all bands of a source; draws are those of a list, over sources of one level and of four."""
    monkeypatch.setattr(windows, "BAND", 5)
    spans = [("a", 100 * k, 12 + k % 9) for k in range(400)] + [("b", 0, 30)] + [("c", 100 * k, 15) for k in range(7)]
    sources, intervals = spark.createDataFrame([(s, 1.0) for s in "abc"], "source string, weight double"), spark.createDataFrame(spans, "source string, start long, length long")
    made = windows.tables(sources, intervals, 12)
    assert made.levels == 4 and all(max(len(x) for x in r if isinstance(x, list)) <= 5 for r in made.intervals.collect())
    release = sampling.Release([{"name": s, "weight": 1.0, "intervals": [(a, k) for t, a, k in spans if t == s]} for s in "abc"], 12)
    got = windows.draw(spark.range(60).select(F.col("id").alias("step"), F.lit(0).alias("rank")), made, 3, 2).collect()
    assert sorted(tuple(r) for r in got) == sorted(d for s in range(60) for d in release.draws(3, s, 0, 2))


@pytest.mark.parametrize("block", [4, 7, 64])
def test_packed_records_are_the_blocks_of_their_symbols(spark, block):
    """symbols move four to a byte, and a range that ends early in the next block is read where it begins."""
    rng = random.Random(1)
    rows = [(s, r, "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 2, 3, 50, 200])))) for s in "ab" for r in range(9)]
    df = spark.createDataFrame(rows, "source string, record long, s string")
    along = store.axis(df.select("source", "record", F.length("s").alias("n")), "source", "record", "n")
    records = df.select("source", "record", F.length("s").alias("n"), store.pack("s").alias("packed")).join(along, ["source", "record"])
    got = store.packed_blocks(records, "source", block)
    chunks = df.select("source", "record", F.lit(0).alias("chunk"), F.col("s").alias("symbols"))
    want = store.blocks(store.placed(chunks, "source", "record", "chunk", "symbols"), "source", "symbols", block)
    assert sorted(got.collect()) == sorted(want.collect())
    whole = {s: "".join(t for q, _, t in rows if q == s) for s in "ab"}
    asked = [(s, a, n) for s in "ab" for a in range(0, len(whole[s]) + 2, 3) for n in (1, block, block + 1)]
    read = store.decode(got, spark.createDataFrame(asked, "source string, start long, length long"), "source", "start", "length", "bases", block)
    assert sorted(tuple(r) for r in read.collect() if r.bases) == sorted((s, a, n, whole[s][a : a + n]) for s, a, n in asked if a + n <= len(whole[s]))
