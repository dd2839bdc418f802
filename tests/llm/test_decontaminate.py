import random

import numpy as np
import pyarrow as pa

from granary.llm import decontaminate as dc


def plain_align(item, passage):
    best, h = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if x == y else -dc.OTHER), h[i - 1][j] - dc.OTHER, h[i][j - 1] - dc.OTHER)
            best = max(best, h[i][j])
    return best


def test_alignment_against_the_full_table():
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        passage = [rng.randrange(5) - 1 for _ in range(rng.randrange(1, 25))]
        score, first, last = dc.align(np.array(item), np.array(passage))
        assert score == plain_align(item, passage)
        if score:
            assert plain_align(item, passage[first : last + 1]) == score


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 40)))) for i in range(12)]
    rows, want = [], set()
    for d in range(150):
        words = [word() for _ in range(rng.randrange(20, 200))]
        if d % 3 == 0:
            i, t = items[d % 11]
            passage = t.split()
            for _ in range(len(passage) // 6 if d % 2 else 0):  # edited copies
                at, how = rng.randrange(len(passage)), rng.randrange(3)
                if how == 0:
                    passage[at] = "edited"
                elif how == 1:
                    passage.insert(at, "added")
                else:
                    del passage[at]
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in passage]
            want.add((d, i))
        rows.append((d, " ".join(words)))
    return items, rows, want


def test_exact_and_edited_copies_are_found_and_clean_documents_are_not(spark):
    items, rows, want = corpus()
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(docs, "doc_id", "text", bench, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.score == 1.0 for r in got if r.doc_id % 2 == 0)


def test_a_common_passage_keeps_its_seeds(spark):
    items, rows, _ = corpus()
    common = items[11][1]
    docs = spark.createDataFrame([(d, f"{t} {common}") for d, t in rows] + [(999, common)], "doc_id long, text string")
    got = dc.contaminated(docs, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").filter("item_id = 11")
    assert got.count() == 151


def test_blocks_of_items_give_the_same_hits(spark, monkeypatch):
    items, rows, want = corpus()
    monkeypatch.setattr(dc, "MOST_BLOCK_BYTES", 600)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, "doc_id", "text", bench, "item_id", "text").collect()} == want


def test_edges(spark):
    bench = spark.createDataFrame([(1, "one two three four five"), (2, None), (3, ""), (None, "x y z"), (4, "short"), (5, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six"), (1, "zero one two three four five six"), (2, None), (3, ""), (None, "ONE two, three four five"), (4, "a short text"), (5, "w " * 40_000)], "doc_id long, text string")
    got = dc.contaminated(docs, "doc_id", "text", bench, "item_id", "text").collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("1", 1), ("1", 1), ("1", 5), ("1", 5), ("4", 4), ("None", 1), ("None", 5)]
    kept = dc.with_hits(docs, "text", bench, "item_id", "text", "hits")
    assert kept.columns == ["doc_id", "text", "hits"] and kept.count() == 7
    assert dc.contaminated(docs.limit(0), "doc_id", "text", bench, "item_id", "text").count() == 0
    assert dc.contaminated(docs, "doc_id", "text", bench.limit(0), "item_id", "text").count() == 0


def test_a_lead_that_many_items_share_is_aligned_only_where_the_rest_matters(spark, monkeypatch):
    """All pairs by brute force; alignments grow with documents, not with documents times items."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9)))
    lead = [word() for _ in range(8)]
    aligned = []
    monkeypatch.setattr(dc, "align", lambda i, p, plain=dc.align: aligned.append(1) or plain(i, p))
    for n in (60, 240):
        items = [" ".join(lead + [word() for _ in range(24)]) for _ in range(n)]
        docs = [" ".join([*(word() for _ in range(20)), *(items[d * 3].split() if d % 2 else lead), *(word() for _ in range(20))]) for d in range(20)]
        block = dc.Items.build(list(range(n)), items)
        chosen = [dc._places(g, np.full(len(block.grams), 20), np.zeros(len(block.grams), bool), dc._shared(block)) for g in block.gram_of]
        assert all(len(p) for p in chosen)
        aligned.clear()
        hits = dc.Aligner(block, chosen, dc.THRESHOLD).hits(pa.array(docs))
        assert len(aligned) <= 20
        _, text, _, _ = dc._found(block, pa.array(docs))
        w = dc._found(block, pa.array(docs))[0]
        want = {(d, i) for d in range(20) for i in range(n) if plain_align(block.words[i].tolist(), w[text == d].tolist()) >= dc.THRESHOLD * dc.MATCH * len(block.words[i])} if n == 60 else {(d, d * 3) for d in range(1, 20, 2)}
        assert {(d, h["item_id"]) for d, found in enumerate(hits) for h in found} == want


def test_scores_side_by_side_equal_the_full_table():
    rng = random.Random(3)
    for _ in range(60):
        n, items, passage = rng.randrange(1, 9), rng.randrange(1, 5), [rng.randrange(5) - 1 for _ in range(rng.randrange(1, 25))]
        rows = [[rng.randrange(4) for _ in range(n)] for _ in range(items)]
        assert dc.best_scores(np.array(rows), np.array(passage)).tolist() == [plain_align(r, passage) for r in rows]


def test_edited_tails_behind_a_shared_lead_equal_brute_force_over_all_pairs():
    """Tails keep two of three, one of two or one of three of their words, so no three of them stand together."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9)))
    leads = [[word() for _ in range(12)] for _ in range(3)]
    common = ["the", "of", "and"]
    for n in (200, 400):
        items = [leads[i % 3] + [rng.choice(common) if k % 5 == 0 else word() for k in range(20)] for i in range(n)]
        docs = []
        for d in range(n):
            item = items[rng.randrange(n)]
            keep = rng.choice([(1, 1, 0), (1, 0), (1, 0, 0), (0, 0, 0, 1), (0,)])
            tail = [w if keep[k % len(keep)] else word() for k, w in enumerate(item[12:])]
            lead = item[:12] if d % 4 else item[3:9]
            docs.append([*(word() for _ in range(rng.randrange(30))), *lead, *tail, *(rng.choice([word(), rng.choice(common)]) for _ in range(rng.randrange(30)))])
        block = dc.Items.build(list(range(n)), [" ".join(x) for x in items])
        chosen = [dc._places(g, np.full(len(block.grams), n), np.zeros(len(block.grams), bool), dc._shared(block)) for g in block.gram_of]
        aligner = dc.Aligner(block, chosen, dc.THRESHOLD)
        texts = pa.array([" ".join(x) for x in docs])
        got = {(d, h["item_id"]) for d, found in enumerate(aligner.hits(texts)) for h in found}
        w, text, _, _ = dc._found(block, texts)
        numbers = np.stack(block.words)
        want = {(d, block.ids[i][0]) for d in range(n) for i in np.flatnonzero(dc.best_scores(numbers, w[text == d]) >= dc.THRESHOLD * dc.MATCH * 32).tolist()}
        assert got == want and len(want) > n // 4
        assert aligner.aligned <= len(want) + 2 * n  # what is aligned one by one are hits, or passages of an item's own n-grams


def test_a_lead_and_two_of_three_own_words_hit():
    lead = [f"lead{k}" for k in range(12)]
    items = [" ".join(lead + [f"own{i}x{k}" for k in range(20)]) for i in range(100)]
    block = dc.Items.build(list(range(100)), items)
    chosen = [dc._places(g, np.ones(len(block.grams), np.int64), np.ones(len(block.grams), bool), dc._shared(block)) for g in block.gram_of]
    doc = " ".join(lead + [f"own5x{k}" if k % 3 else "changed" for k in range(20)])
    (found,) = dc.Aligner(block, chosen, dc.THRESHOLD).hits(pa.array([doc]))
    assert [(h["item_id"], h["score"]) for h in found] == [(5, 0.671875)]
