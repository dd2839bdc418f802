import base64

import pytest
import tiktoken

from granary.llm import token_counts as tc
from granary.llm.queries import VOCABULARY

TEXTS = ["Hello world", "", None, "Hello world", "<|endoftext|> a", "é ü " * 50, "word " * 4000, "a", "\n\n\n", "x" * 5000]


@pytest.fixture(scope="module")
def encode():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(VOCABULARY, "rb").read().splitlines())}
    return tiktoken.Encoding("t", pat_str=tc.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_histogram_answers_every_limit(spark, encode):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    lengths = tc.token_lengths(df, "text", VOCABULARY, keep=("doc_id",))
    want = {i: len(encode(t)) if t else 0 for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in lengths.collect()} == want
    histogram = tc.length_histogram(lengths)
    values, total = sorted(want.values()), sum(want.values())
    rows = histogram.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(values))
    for r in rows:
        n = r.n_tokens
        assert r.documents == values.count(n) and r.fitting_documents == sum(v <= n for v in values) and r.longer_documents == sum(v > n for v in values)
        assert r.fitting_tokens == sum(v for v in values if v <= n) and r.suffix_tokens == sum(v for v in values if v >= n)
        assert r.truncated_total == sum(min(v, n) for v in values) and r.all_tokens == total and r.all_documents == len(values)
        assert r.quantile == pytest.approx(r.fitting_documents / len(values))
    for x in tc.limit_totals(histogram, [0, 1, 2, 100, 10**6]).collect():
        assert x.kept_tokens == sum(min(v, x.context) for v in values) and x.total_tokens == total and x.fitting_documents == sum(v <= x.context for v in values)
    assert tc.length_quantile(histogram, 0.5).first().n_tokens == values[-(-len(values) // 2) - 1]
    assert tc.length_quantile(histogram, 1.0).first().n_tokens == values[-1]


def test_empty(spark):
    assert tc.length_histogram(tc.token_lengths(spark.createDataFrame([], "text string"), "text", VOCABULARY)).count() == 0


def test_vocabulary_size_is_checked(tmp_path, monkeypatch):
    (tmp_path / "v").write_bytes(b"QQ== 0\n")
    monkeypatch.setattr(tc, "MOST_VOCABULARY_BYTES", 3)
    with pytest.raises(ValueError):
        tc.vocabulary(str(tmp_path / "v"))
