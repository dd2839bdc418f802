import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import blocks, suffix_dedup


def brute(rows, length=100):
    """{(key, text): (n_bytes, n_removed, n_spans, sha)} for rows sorted by key; equal rows count once."""
    seen, out = {}, {}
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for key, text in rows:
        b = (text or "").encode()
        for j in range(len(b) - length + 1):
            seen.setdefault(b[j : j + length], (key is not None, key or 0, j))
    for key, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] < (key is not None, key or 0, j):
                gone[j : j + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[key, text] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, hot=4096):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, block string")
    got = suffix_dedup.remove_repeats(df, "doc_id", "text", block_bytes=3000, hot=hot).collect()
    want = brute([(k, t or "") for k, t in rows])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(k), *want[k, t or ""]) for k, t in rows)


def test_against_brute_force(spark):
    rng = random.Random(2)
    letters = "abcdefgh é"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(rng.randrange(60, 400)) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else word(rng.randrange(200)) for _ in range(rng.randrange(6))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "ab" * 400), (103, "ab" * 399 + "c"), (104, "x" * 3000), (105, "x" * 2999), (106, "the the " * 50), (107, "y " + "the the " * 50)]
    rows += [(200, rows[5][1]), (200, rows[5][1]), (None, rows[7][1]), (3000, rows[7][1]), (-5, rows[9][1])]
    for hot in (4096, 6, 2):
        check(spark, rows, hot)


def test_long_text_and_hot_line(spark):
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefghij ") for _ in range(90))
    long = "".join(rng.choice("abcdef ") for _ in range(40_000))
    rows = [(i, f"{rng.random()} {line} {rng.random()}" * 2) for i in range(120)]
    rows += [(500, long), (501, long[5000:25_000] + "!" + long[:3000]), (502, long[:99]), (503, "z" + long[100:200])]
    for hot in (4096, 50):
        check(spark, rows, hot)


def test_blocks_without_any_string(spark):
    check(spark, [(1, "short"), (2, None), (3, "short"), (4, "x" * 99)])
    check(spark, [(1, "é" * 50), (2, "é" * 50)], 2)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=20, max_size=80), min_size=1, max_size=8))
def test_expansion_cuts_the_order_into_classes_of_equal_strings(texts):
    length = 12
    text = np.frombuffer(b"\xff".join(t.encode() for t in texts) + b"\xff", np.uint8)
    order = suffix_dedup.suffix_order(text, length)
    cls = np.empty(len(text), np.int64)
    cls[order] = np.cumsum(suffix_dedup.expand(text, order, length))
    strings = {i: text[i : i + length].tobytes() for i in range(len(text) - length + 1) if 0xFF not in text[i : i + length]}
    for i, a in strings.items():
        for j, b in strings.items():
            assert (cls[i] == cls[j]) == (a == b)
    for i in set(range(len(text))) - set(strings):
        assert all(cls[i] != cls[j] for j in strings)


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_packing_round_trips(n):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    assert (blocks.unpack_sorted(blocks.pack_sorted(values)) == values).all()
    counts = rng.integers(-5, 1 << 40, n)
    assert (blocks.unpack(blocks.pack(counts)) == counts).all()
    cuts = blocks.range_cuts(values, 7)
    assert cuts[0] == 0 and cuts[-1] == n and (np.diff(cuts) >= 0).all()
