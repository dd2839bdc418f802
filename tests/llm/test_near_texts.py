import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import near_texts
from granary.operators import near_copies


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
    for g in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([6, 8, 14, 60, 200, 700]))]
        for c in range(rng.choice([1, 3, 9])):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((g * 100 + c, " ".join(copy) + (line if g % 3 else "")))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "x " * 30_000), (9006, line), (9007, line + "so it goes")]
    return rows


@pytest.mark.parametrize("more", [{}, {"sample": 1, "block": 3}])
def test_one_of_each_against_brute_force(spark, near_rows, more):
    df = spark.createDataFrame([(k, t, "x") for k, t in near_rows], "doc_id long, text string, row string")
    want = brute(near_rows)
    assert len(set(want.values())) < len(near_rows) - 40
    got = near_texts.one_of_each(df, "doc_id", "text", **more)
    assert got.schema == df.schema
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_null_keys_repeated_rows_and_clashing_columns(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a", 1), (1, text, "a", 1), (1, "eight nine ten eleven twelve", "b", 2), (None, text, "c", 3), (None, "what no other row has at all", "d", 4), (None, "what no other row has at all", "d", 4), (2, None, "e", 5), (3, "", "f", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, `row_1` int")
    got = sorted(map(str, near_texts.one_of_each(df, "doc_id", "text").collect()))
    assert got == sorted(map(str, (df.collect()[i] for i in (0, 2, 4, 6))))
    assert near_texts.one_of_each(df.limit(0), "doc_id", "text").count() == 0


def test_two_words_are_equal_wherever_sets_are_similar():
    rng = np.random.default_rng(3)
    for _ in range(4000):
        n = int(rng.integers(1, 140))
        a = rng.integers(1, (1 << 64) - 1, n, dtype=np.uint64)
        differ = int(np.floor(2 * 0.2 / 1.8 * n + 1e-9))
        take = int(rng.integers(0, differ + 1))
        b = np.append(a[: n - take // 2 - take % 2], rng.integers(1, (1 << 64) - 1, take // 2, dtype=np.uint64))
        sets = [np.unique(a), np.unique(b)]
        both = len(np.intersect1d(*sets))
        if both < 0.8 * (len(sets[0]) + len(sets[1]) - both):
            continue
        made = [{(m, int(lev[0])): w[0] for _, m, lev, _, w in near_texts.long_prints(s, np.array([len(s)]), np.zeros(0, np.uint64))} for s in sets]
        kinds = made[0].keys() & made[1].keys()
        assert kinds
        equal = max(sum(x == y and x != 0 for x, y in zip(made[0][k], made[1][k])) for k in kinds)
        assert equal >= 2 or both < 3


def test_maps_at_any_depth_come_through(spark):
    kind = "doc_id long, text string, a map<string,int>, b struct<x: map<string,int>, y: array<struct<z: map<string,int>>>>"
    text = "one two three four five six seven"
    rows = [(1, text, {"k": 1}, ({"k": 1}, [({"k": 2},)])), (2, text, None, (None, [])), (3, "other", {"k": 1}, None), (3, "other", {"k": 2}, None)]
    got = near_texts.one_of_each(spark.createDataFrame(rows, kind), "doc_id", "text").collect()
    assert sorted(r.doc_id for r in got) == [1, 3]
    assert next(r for r in got if r.doc_id == 1).b.y[0].z == {"k": 2}


def test_components_on_the_largest_table_equal_the_exact_join(spark):
    """Recall and precision of the whole stage, by component ids."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = near_texts.grouped(docs, "doc_id", "text")
    got = found.join(found.groupBy("root").agg(F.min("key").alias("first")), "root").select("key", "first").collect()
    want = near_copies.clusters(docs, "doc_id", "text").collect()
    assert {r.key: r["first"] for r in got} == {r.doc_id: r.component_id for r in want}


def test_common_shingles_are_counted_over_all_texts(spark):
    """Every text counts, whatever its hash, and nothing caps the classes that are common."""
    line = "a line that stands in six of the texts"
    rows = [(i, f"{line} and then {i} goes on with words of its own {i * 7}") for i in range(6)] + [(i, f"number {i} says what no other {i} says here {i}") for i in range(6, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts, sets = df.select("text"), [near_copies.shingle_hashes(pa.array([t]), 5)[0] for _, t in rows]
    flat = np.concatenate(sets)
    classes, n = np.unique(near_texts._class(flat), return_counts=True)
    assert {r["class"]: r["n"] for r in near_texts._counted(texts).collect()} == dict(zip(classes.tolist(), n.tolist(), strict=True))
    common = near_texts._common(texts, 6)
    shingles = near_copies.shingle_hashes(pa.array([line]), 5)[0]
    assert len(shingles) == 5 and near_texts.is_common(shingles, common).all()
    assert near_texts.is_common(flat, common).sum() == sum(n[n >= 6])
    assert not near_texts._common(texts, 7 + max(n)).any() and not near_texts._common(texts.limit(0), 1).any()


class _Caught:
    """Stands for a table: keeps the function that each batch would go through."""

    def mapInArrow(self, function, _):
        self.map = function
        return self

    def groupBy(self, _):
        return self

    def applyInArrow(self, function, _):
        return self


def _peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_counting_shingles_takes_little_memory_whatever_the_batch():
    """A worker's arrays are those of one part of a batch and two bytes a class."""
    rng = random.Random(3)
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(str(rng.randrange(10**6)) for _ in range(3000)) for _ in range(400)])], ["text"])
    caught = near_texts._counted(_Caught())
    held, peak = _peak(lambda: sum(len(out.column(1).flatten()) for out in caught.map(iter([batch]))))
    flat = np.concatenate([near_copies.shingle_hashes(batch.column(0).slice(a, 50), 5)[0] for a in range(0, 400, 50)])
    assert held == len(np.unique(near_texts._class(flat))) and peak < 64 << 20


def test_counts_of_shingles_go_beyond_two_bytes():
    """One task counts a shingle of more than 65,536 texts, once or twice over, in full."""
    batch = pa.RecordBatch.from_arrays([pa.array(["the same five words here"] * 50_000 + ["a b c d e f"])], ["text"])
    caught = near_texts._counted(_Caught())
    n = np.concatenate([out.column(2).flatten().to_numpy() for out in caught.map(iter([batch] * 3))])
    assert sorted(n.tolist()) == [3, 3, 150_000]


def test_votes_of_many_runs_are_those_of_each():
    rng = np.random.default_rng(4)
    sizes = np.array([1, 3, near_texts._VOTING + 5, 2, 40_000, 7, 1])
    h = rng.integers(0, 1 << 63, sizes.sum(), np.uint64)
    first = np.cumsum(sizes) - sizes
    each = [near_texts._votes(h[a : a + n], np.zeros(1, np.int64), np.array([n]))[0] for a, n in zip(first, sizes, strict=True)]
    assert near_texts._votes(h, first, sizes).tolist() == each
