"""What the findings of round three named."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from granary.functions import text
from granary.operators import audit, batches, kmers, resolve, sampling, store


def test_pairing_keeps_every_pair(spark):
    """groups of more members than any preview lose none; both sides count the same pairs."""
    left = spark.createDataFrame([(1, "x", "f"), (2, "q", "f"), (3, "q", "f"), (4, "q", "g"), (5, None, None)], "lid int, k string, f string")
    right = spark.createDataFrame([("x", "f", i) for i in range(40)] + [("y", "f", i) for i in range(40, 70)] + [("z", "h", 99)], "k2 string, f2 string, rid int")
    got = resolve.whole_pairing(left, right, ("k", "k2"), ("f", "f2"), "lid", "rid").collect()
    pairs = {(a.id, b.id) for a in got for b in got if (a.side, b.side) == ("left", "right") and a.pair_level and (a.pair_level, a.pair_key) == (b.pair_level, b.pair_key)}
    assert pairs == {(1, i) for i in range(40)} | {(x, i) for x in (2, 3) for i in range(70)}
    assert {r.id: r.paired_count for r in got if r.side == "left"} == {1: 40, 2: 70, 3: 70, 4: 0, 5: 0}
    assert sum(r.paired_count for r in got if r.side == "right") == len(pairs)


def test_kmers_hash_as_md5_does():
    """F16: hashes of many k-mers at once are the first 60 bits of their MD5; words are those of their texts."""
    rng = random.Random(1)
    for size in (1, 2, 5, 21, 31, 32, 55):
        texts = np.frombuffer(bytes(rng.choice(b"ACGT") for _ in range(size * 50)), np.uint8).reshape(50, size)
        assert kmers.md5_heads(texts).tolist() == [int(hashlib.md5(x.tobytes()).hexdigest()[:15], 16) for x in texts]
    for size in (1, 2, 5, 21, 31, 32):
        text = bytes(rng.choice(b"ACGTN" if i % 40 == 0 else b"ACGTacgt") for i in range(300))
        known = [w for i in range(len(text) - size + 1) if b"N" not in (w := text[i : i + size].upper())]
        least = {min(w, w.translate(bytes.maketrans(b"ACGT", b"TGCA"))[::-1]) for w in known}
        assert kmers.canonical_codes(text, size).tolist() == sorted(int("".join(str("ACGT".index(chr(c))) for c in w), 4) for w in least)


def test_a_range_within_a_block_is_not_shuffled_with_its_bases(spark):
    """bases that are read in one block stay in the task that read them; equal and unsound ranges are all there."""
    chunks = spark.createDataFrame([("a", 0, 0, "ACGTN" * 20), ("a", 1, 0, ""), ("a", 2, 0, "GGccT" * 4)], "source string, record long, chunk long, symbols string")
    blocks = store.blocks(store.placed(chunks, "source", "record", "chunk", "symbols"), "source", "symbols", 16)
    asked = [("a", 3, 5), ("a", 3, 5), ("a", 10, 40), ("a", 10, 40), ("a", 118, 2), ("a", 118, 3), ("a", 112, 9), ("a", -1, 2), ("a", 0, 0), (None, 0, 1), ("b", 0, 1), ("a", None, 1)]
    got = store.decode(blocks, spark.createDataFrame(asked, "source string, start long, length long"), "source", "start", "length", "bases", 16)
    text = ("ACGTA" * 20 + "GGCCT" * 4)
    want = sorted(((s, a, n, text[a : a + n] if s == "a" and a is not None and 0 <= a < a + n <= 120 else None) for s, a, n in asked), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan.split("Join LeftOuter")) == 3 and plan.index("MapInArrow") < plan.index("Join LeftOuter")  # bases come last in the first branch


def test_masks_are_made_for_a_bounded_number_of_ids(spark, monkeypatch):
    """rows of one batch are masked in parts, with the same masks."""
    texts = spark.createDataFrame([(i, "ACGT" * (7 * i % 50) if i % 9 else None) for i in range(60)], "k int, ids string").coalesce(1)
    lists = texts.select("k", F.transform(F.sequence(F.lit(1), F.col("k")), lambda x: x % 4 + 2).alias("ids")).filter("k > 0")
    for df in (texts, lists):
        whole = sorted(sampling.span_mask(df, ["k"], "ids", 3).collect())
        monkeypatch.setattr(sampling, "AT_ONCE", 100)
        assert sorted(sampling.span_mask(df, ["k"], "ids", 3).collect()) == whole
        monkeypatch.undo()
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 30, None, "", "b" * 200, "c" * 40, "d" * 40])], ["x"])
    parts = list(batches.bounded(batch, 0, 100))
    assert len(parts) > 1 and pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()


def test_titles_of_odd_texts(spark):
    """texts are made one by one, nulls and empty ones among them."""
    df = spark.createDataFrame([(1, "<b>Ärger</b> &amp; ﬁn①"), (2, None), (3, ""), (4, " <x> -- "), (5, "STRASSE ß")], "k int, t string")
    assert {r.k: r.v for r in df.select("k", text.title("t").alias("v")).collect()} == {1: "ärger fin1", 2: None, 3: "", 4: "", 5: "strasse ss"}
    assert text.title.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def test_missing_and_extra_is_one_aggregate(spark):
    """no join of both tables; repeated and null keys count as they did."""
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 1, 2, 3, None], [3, 3, 4, 4, None]))
    got = audit.missing_and_extra(a, b, "k")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "missing"), (2, "missing"), (4, "extra"), (None, "missing"), (None, "extra")], key=str)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
