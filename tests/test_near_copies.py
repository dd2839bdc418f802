import itertools
import os
import random

import pyarrow as pa
import pytest

from granary.operators import near_copies
from granary.plans.queries import QUERIES


def shingle_set(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def brute(rows, threshold=0.8):
    """Smallest key of each row's component, by all pairs."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x == y or len(x & y) >= threshold * len(x | y) > 0:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {r: min(k for (k, _), q in zip(rows, root) if q == r) for r in root}
    return {k: least[r] for (k, _), r in zip(rows, root)}


@pytest.fixture(scope="module")
def near_rows():
    """Copies with edits around a similarity of 0.8, short texts, and a line that most of them share."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    line = " this line stands in very many of the documents of the whole collection "
    rows = []
    for g in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 200]))]
        for c in range(rng.choice([1, 3, 9])):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((g * 100 + c, " ".join(copy) + (line if g % 3 else "")))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "x " * 30_000), (9006, line), (9007, line + "so it goes")]
    return rows


@pytest.mark.parametrize(("small", "sample"), [(48, 16), (2, 1)])
def test_clusters_against_brute_force(spark, near_rows, small, sample):
    df = spark.createDataFrame(near_rows, "doc_id long, text string")
    got = near_copies.clusters(df, "doc_id", "text", small=small, sample=sample).collect()
    want = brute(near_rows)
    assert len(set(want.values())) < len(near_rows) - 40
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(near_rows)
    assert near_copies.clusters(df.limit(0), "doc_id", "text").count() == 0


def test_slices_are_hashed_as_whole_arrays(near_rows):
    texts = pa.array([t for _, t in near_rows])
    whole, counts = near_copies.shingle_hashes(texts)
    assert counts.tolist() == [len(shingle_set(t)) for _, t in near_rows]
    h, n = near_copies.shingle_hashes(texts.slice(7, 50))
    assert n.tolist() == counts[7:57].tolist() and h.tolist() == whole[counts[:7].sum() : counts[:57].sum()].tolist()


def test_whole_sets_of_shingles(spark, tmp_path, near_rows):
    """Every shingle counts: short copies are linked, and similarities are those of whole sets."""
    rows = [(k, None if t is None else t.lower()) for k, t in near_rows]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    empty = {k for k, t in rows if not (t or "").split()}
    want = {k: k if k in empty else c for k, c in brute(rows).items()}
    got = QUERIES["near_dup_components"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.component for r in got} == want and len(got) == len(rows)
    assert all(r.component_size == list(want.values()).count(r.component) for r in got)
    heads = {}
    for k, t in sorted(r for r in rows if r[0] not in empty):
        heads.setdefault(frozenset(shingle_set(t)), k)
    pairs = {(min(a, b), max(a, b)): len(x & y) / len(x | y) for x, a in heads.items() for y, b in heads.items() if a < b and len(x & y) >= 0.8 * len(x | y)}
    found = {(r.left, r.right): r.jaccard for r in QUERIES["shingle_jaccard"](spark, str(tmp_path)).collect()}
    assert found == pytest.approx(pairs, abs=1e-9) and len(pairs) > 20


def test_pairs_of_a_group_are_verified_together(spark):
    """A set is sent once to a cell, not once a pair: a group of 40 nodes is one cell, or cells of two blocks; so is a star."""
    group = [(a, b) for b in range(100, 140) for a in range(100, b)]
    star = [(a, 999) for a in range(900, 940)]
    pairs = spark.createDataFrame(group + star, "a long, b long")
    one = near_copies._cells(pairs, 64).collect()
    assert sorted((r.a, r.b) for r in one) == sorted(group + star) and {(r.g, r.i, r.j) for r in one} == {(100, 0, 0), (900, 0, 0)}
    many = near_copies._cells(pairs, 8).collect()
    assert sorted((r.a, r.b) for r in many) == sorted(group + star) and all(r.i <= r.j < 6 for r in many)
    assert len({(r.g, r.i, r.j) for r in many if r.g == 100}) <= 15
    sets = spark.createDataFrame([(n, list(range(n % 10, n % 10 + 30))) for n in [*range(100, 140), *range(900, 940), 999]], "node long, items array<long>")
    want = {(a, b): (30 - abs(a % 10 - b % 10)) / (30 + abs(a % 10 - b % 10)) for a, b in group + star}
    for block in (4, 64):
        got = {(r.a, r.b): r.jaccard for r in near_copies._verified(pairs, sets, 0.8, block).collect()}
        assert got == {k: v for k, v in want.items() if v >= 0.8}


def test_sets_are_neither_stored_nor_sent(spark, tmp_path, near_rows, monkeypatch):
    """F8, F10, F12: what is written is narrow or short-lived, and cells get compressed texts, not lists of hashes."""
    kept = []
    own = near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df, label: kept.append((label, own(df, label))) or kept[-1][1])
    df = spark.createDataFrame([(k if k < 9000 else None, t) for k, t in near_rows], "doc_id long, text string")
    made = near_copies.nodes(df, "doc_id", "text", lower=True)
    found = near_copies.node_pairs(made).collect()
    assert [label for label, x in kept if any(c == "items" for c in x.columns)] == []
    assert not os.path.exists(dict(kept)["dealt"].inputFiles()[0].removeprefix("file://"))
    texts = [t for _, t in near_rows]
    sets = {frozenset(s) for t in texts if (s := shingle_set(t))}
    want = sorted(len(x & y) / len(x | y) for x, y in itertools.combinations(sets, 2) if len(x & y) >= 0.8 * len(x | y))
    assert sorted(r.jaccard for r in found) == pytest.approx(want)  # rows without a key are nodes as well
    ends = spark.createDataFrame([(near_rows[0][0], [1]), (None, [2])], "key long, cells array<int>")
    got = [near_copies._unpacked(r.packed).decode() for r in near_copies._texts_of(made.texts, ends).collect() if r.packed is not None]
    assert sorted(got) == sorted(t for k, t in near_rows if t is not None and (k == near_rows[0][0] or k >= 9000))
