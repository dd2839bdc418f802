import random
import re

import numpy as np
import xxhash

from granary.llm import simhash


def reference_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def labels(values, distance=3):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (int(values[i]) ^ int(values[j])).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    for t in ["", " \t\n", "One", "one two", "One two THREE", "a b c d e", "É é Ü x y", "the the the the", "x " * 40_000]:
        assert simhash.fingerprint(t.encode()) == reference_print(t)


def test_blocks_meet_every_close_pair():
    masks = simhash.masks(simhash.BLOCKS, simhash.DISTANCE)
    rng = random.Random(1)
    assert len(masks) == 20
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)
    finer = simhash.masks(simhash.FINER, simhash.DISTANCE)
    assert len(finer) == 84 and min(m.bit_count() for m in finer) >= 42


def test_forest_is_exact_for_small_and_large_groups(monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = set()
    while len(values) < 700:
        x = rng.choice(base)
        for bit in rng.sample(range(24), rng.randrange(6)):
            x ^= 1 << bit
        values.add(x)
    f = np.array(sorted(values), np.uint64)
    want = labels(f)
    assert simhash.forest(f).tolist() == want
    monkeypatch.setattr(simhash, "COMPARED_AT_ONCE", 32)
    assert simhash.forest(f).tolist() == want


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        words = [rng.choice(vocabulary) for _ in range(300)]
        for c in range(rng.randrange(1, 8)):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((g * 100 + c, " ".join(copy)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "x " * 30_000), (0, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df, "doc_id", "text").collect()
    finer = simhash.near_duplicates(df, "doc_id", "text", bucket=1).collect()
    assert sorted(map(str, got)) == sorted(map(str, finer))
    prints = [reference_print(t) for _, t in rows]
    root = labels(prints)
    least = {r: min(k for (k, _), q in zip(rows, root) if q == r and k is not None) for r in root}
    want = sorted((str(k), f"{p:016x}", least[r]) for (k, _), p, r in zip(rows, prints, root))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(df.limit(0), "doc_id", "text").count() == 0
