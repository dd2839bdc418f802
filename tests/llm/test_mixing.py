import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import mixing


def fixture(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    kinds = {"a": "red green blue", "b": "one two three four", "c": "cat dog cow"}
    rows, labels = [], []
    for i in range(n):
        k = list(kinds)[i % 3]
        words = kinds[k].split() + ["and", "or"]
        rows.append((i, " ".join(rng.choice(words, int(rng.integers(3, 40)))), "x"))
        if i % 2:
            labels.append((i, k))
    return spark.createDataFrame(rows, "doc_id long, text string, mix_rate string"), spark.createDataFrame(labels, "doc_id long, y string")


def test_totals_match_targets(spark):
    docs, labels = fixture(spark)
    rated, domains, report = mixing.mix(docs, labels, "doc_id", "text", F.col("y"), {"a": 0.6, "b": 0.3, "c": 0.1})
    rows = rated.collect()
    t, p, r = np.array([x.mix_tokens for x in rows]), np.array([x.mix_posterior for x in rows]), np.array([x.mix_rate for x in rows])
    assert domains == ["a", "b", "c"] and (r >= 0).all() and np.allclose(p.sum(1), 1)
    assert np.allclose((t * r) @ p / t.sum(), [0.6, 0.3, 0.1], atol=1e-5)
    for x, want in zip(report, (0.6, 0.3, 0.1), strict=True):
        assert x["expected"] / t.sum() == pytest.approx(want, abs=1e-5)
    true = {r.doc_id: r.y for r in labels.collect()}
    assert np.mean([domains[int(np.argmax(x.mix_posterior))] == true[x.doc_id] for x in rows if x.doc_id in true]) > 0.95


def test_rates_equal_plain_projected_gradient(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4] * 3, 80)
    t = rng.integers(1, 50, 80)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "mix_tokens long, mix_posterior array<double>")
    for most, weights in ((None, [0.9, 0.1, 0.0]), (1.0, [0.2, 0.5, 0.3])):
        rate, report = mixing.fit_rates(df, ["a", "b", "c"], dict(zip("abc", weights, strict=True)), most=most)
        got = np.array([r[0] for r in df.select(rate).collect()])
        have = t @ p
        target = np.array(weights) * t.sum()
        if most:
            target = np.minimum(target, have * most)
        inverse = np.linalg.pinv((p * t[:, None]).T @ p + 1e-9 * max(np.trace((p * t[:, None]).T @ p), 1) * np.eye(3))
        r, reached = np.ones(80), have
        for _ in range(report[0]["steps"]):
            r = np.clip(r - p @ (inverse @ (reached - target)), 0, most)
            reached = (t * r) @ p
        assert np.allclose(got, r, atol=1e-9)
        assert np.abs(reached - target).max() <= np.abs(have - target).max() + 1e-9


def test_edges(spark):
    docs, labels = fixture(spark, 30)
    odd = docs.unionByName(spark.createDataFrame([(900, None, "x"), (901, "", "x"), (None, "red", "x"), (1, "red", "x"), (902, "cat " * 30_000, "x")], docs.schema))
    rated, _, _ = mixing.mix(odd, labels.unionByName(spark.createDataFrame([(1, "c"), (None, "a"), (5000, "b"), (3, None)], labels.schema)), "doc_id", "text", F.col("y"), {"a": 1.0})
    rows = rated.collect()
    assert len(rows) == 35 and all(np.isfinite(r.mix_rate) and r.mix_rate >= 0 for r in rows)
    none, domains, _ = mixing.mix(docs, labels.limit(0), "doc_id", "text", F.col("y"), {"a": 1.0})
    assert domains == ["all"] and {r.mix_rate for r in none.collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labels, "doc_id", "text", F.col("y"), {"a": 1.0})[0].count() == 0
    u = spark.range(2000).select(mixing.draw(F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= u[0] and u[1] < 1 and abs(u[2] - 0.5) < 0.05
