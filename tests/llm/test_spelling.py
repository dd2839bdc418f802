"""Spelling variants against all pairs of words, and their defined results."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.llm import spelling


def counted(docs):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def is_near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n), key=repr)


def some_docs():
    rnd = random.Random(3)
    letters = "aabcÿ×é"
    stems = ["".join(rnd.choice(letters) for _ in range(rnd.randint(5, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "ababababa", "x" * 60, "x" * 61, "y" + "x" * 60]
    words = list(stems)
    for s in stems:
        for _ in range(4):
            i = rnd.randrange(len(s) + 1)
            words.append(rnd.choice([s[:i] + rnd.choice(letters) + s[i:], s[:i] + s[i + 1 :], s[:i] + rnd.choice(letters) + s[i + 1 :]]))
    docs = [(k, " ".join(rnd.choice(words[: rnd.choice([5, 50, len(words)])]).upper() if k % 5 == 0 else rnd.choice(words) for _ in range(300))) for k in range(20)]
    return [*docs, docs[1], docs[1], (None, docs[2][1]), (None, docs[2][1]), (90, None), (91, ""), (92, "123 āā ß!"), (93, ("x" * 60 + " ") * 30_000)]


@pytest.mark.parametrize("most", [2, 12, 1024])
def test_equals_all_pairs(spark, most):
    docs = some_docs()
    df = spark.createDataFrame(docs, "word long, n string").repartition(3)
    got = spelling.variants(df, "word", "n", most_block=most if most > 90 else max(most, 10))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(counted(docs))


def test_blocks_end_within_the_bound_and_hold_each_pair_once(spark):
    letters = "abcdefgh"
    words = [a + b + c + "xyz" for a in letters for b in letters for c in letters] + ["xyz" + a + b for a in letters for b in letters]
    known = spark.createDataFrame([(w, 3 + i) for i, w in enumerate(words)], "word string, n long")
    dealt = spelling.blocks(known, 20)
    assert dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] <= 20
    near = {r["word"]: r["n_near"] for r in spelling.near_words(known, 20).collect()}
    assert near == {w: k for w in words if (k := sum(is_near(w, x) for x in words))}


def test_first_difference():
    assert [spelling.first_difference(*p) for p in (("abc", "abd"), ("abc", "abcd"), ("aab", "aaab"), ("abc", "abc"), ("abc", "bca"), ("abc", "abcde"), ("", "a"))] == [2, 3, 2, -1, -1, -1, 0]


def test_roots_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}" if i < 40 else None) for i in range(41)] + [(f"v{i}", "w000") for i in range(50)], "word string, form string")
    assert {r["root"] for r in spelling.roots(links, "word", "form").collect()} == {"w040"}


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").collect() == []
