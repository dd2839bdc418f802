"""Mixing sources to target weights by soft domain membership.

A softmax classifier trained on a labelled table predicts each document's posterior over
domains.  Nonnegative rates (expected uses of a document) are then fitted so that the
expected token totals of the domains match targets: least squares by projected gradient,
in the metric of the domains' Gram matrix, so that a step with no clipped rate would
solve the problem at once.

A rate is a function of the document's posterior and of the step history, which holds
one short vector per step.  So a step is one aggregate of as many sums as there are
domains over a narrow table, with nothing shuffled but those sums, and no rate is stored
between steps.  The classifier is fitted on at most ``SAMPLE_ROWS`` labelled documents;
everything else covers all rows.

Defined results: null and empty texts have no tokens, the prior posterior, and rate 1
until steps move it; rows with the same text share posterior and rate; labels that are
null or have no document are ignored, a document labelled twice takes the smaller domain
name; targets of domains that no document resembles cannot be met and show as a rest in the report;
with no labels at all every document gets rate 1 and a uniform posterior; texts of any length
are read whole, by one task, in parts; columns ``keep`` come through whatever their names, but
for the three of the result; an empty table gives an empty result and a report without tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import features
from granary.operators.lineage import written

BUCKETS = 1 << 18
#: Bound on the labelled rows that the classifier is fitted on.
SAMPLE_ROWS = 12_000
STEPS = 60
#: Largest rest of a domain, as a share of all tokens, at which fitting stops.
TOLERANCE = 1e-7


def _present(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of the distinct tokens of each text, and tokens by text."""
    h, text = features.tokens(part)
    found = np.unique(text * BUCKETS + features.bucket(h, BUCKETS))
    return found % BUCKETS, found // BUCKETS, np.bincount(text, minlength=len(part))


@dataclass
class Classifier:
    """Domain names, a weight per bucket and domain, and biases."""

    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posterior by text and tokens by text."""
        b, text, n = _present(part)
        z = np.stack([np.bincount(text, self.weights[b, k], minlength=len(part)) for k in range(len(self.domains))], 1) + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True), n


def train(rows: list[np.ndarray], labels: np.ndarray, domains: list[str], epochs: int = 12, rate: float = 0.3, decay: float = 1e-6, seed: int = 5) -> Classifier:
    """Softmax regression on presence features by Adagrad over shuffled mini-batches."""
    rng = np.random.default_rng(seed)
    k = len(domains)
    w, b = np.zeros((BUCKETS, k), np.float64), np.log(np.bincount(labels, minlength=k) + 1.0) - np.log(len(labels) + k)
    gw, gb = np.full((BUCKETS, k), 1e-3), np.full(k, 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            flat = np.concatenate([rows[i] for i in pick])
            of = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
            z = np.stack([np.bincount(of, w[flat, j], minlength=len(pick)) for j in range(k)], 1) + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            here, back = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(back, p[of, j], minlength=len(here)) for j in range(k)], 1) / len(pick) + decay * w[here]
            gw[here] += g * g
            w[here] -= rate * g / np.sqrt(gw[here])
            g = p.mean(0)
            gb += g * g
            b -= rate * g / np.sqrt(gb)
    return Classifier(domains, w.astype(np.float32), b)


def fit_classifier(docs: DataFrame, labels: DataFrame, key: str, text: str, domain: Column, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """The classifier for column ``domain`` (of ``labels``), from a bounded sample drawn by a hash of the key."""
    named = labels.select(F.col(key).alias("id"), domain.alias("y")).filter("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    sample = named.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    plain = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    joined = plain.join(F.broadcast(sample), F.col("k") == F.col("id")).select("k", "y", "t")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in features.parts(batch.column(2)):
                b, of, _ = _present(part)
                cuts = np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(cuts), pa.array(b.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), column], ["k", "y", "b"])
                at += len(part)

    # Collected as rows: each task's first rows go to the driver at once, and none are gathered in one task before.
    rows = joined.mapInArrow(sparse, f"k {dict(docs.dtypes)[key]}, y string, b array<int>").orderBy(F.xxhash64("k", "b"), "k").limit(2 * sample_rows).collect()
    rows.sort(key=lambda r: (r["k"], r["y"], len(r["b"])))
    domains = sorted({r["y"] for r in rows})
    if not domains:
        return Classifier(["all"], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    return train([np.array(r["b"], np.int64) for r in rows], np.array([domains.index(r["y"]) for r in rows]), domains)


def posteriors(docs: DataFrame, text: str, model: Classifier, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, mix_tokens and mix_posterior (in the order of the model's domains) of every row."""
    schema = features.schema(docs, keep, "mix_tokens long, mix_posterior array<double>")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = [np.zeros((0, len(model.domains)))], [np.zeros(0, np.int64)]
            for part in features.parts(batch.column(0)):
                a, b = model.posteriors(part)
                p.append(a)
                n.append(b)
            flat = np.concatenate(p)
            cuts = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
            column = pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(n)), column], [*keep, "mix_tokens", "mix_posterior"])

    return docs.select(F.col(text).alias("__text"), *keep).mapInArrow(apply, schema)


def rate_column(history: list[np.ndarray], most: float | None) -> Column:
    """A document's rate after the steps of ``history``: each moves it along its posterior, then clips it."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in history))

    def step(r: Column, c: Column) -> Column:
        moved = r
        for k in range(len(history[0])):
            moved = moved - F.col("mix_posterior")[k] * c[k]
        moved = F.greatest(moved, F.lit(0.0))
        return moved if most is None else F.least(moved, F.lit(float(most)))

    return F.aggregate(steps, F.lit(1.0), step)


def fit_rates(table: DataFrame, domains: list[str], weights: dict[str, float], total: float | None = None, anchor: str | None = None, most: float | None = None) -> tuple[Column, list[dict]]:
    """Rate column for a table with mix_tokens and mix_posterior, and a report by domain.

    Steps end when the largest rest of a domain is ``TOLERANCE`` of all tokens, when a step no
    longer lowers it (no rates meet the targets: the report's ``met`` is false), or after ``STEPS``.

    ``weights`` are target shares of tokens.  Their total is ``total``; with ``anchor``, the
    total at which that domain's expected tokens are all used; else all tokens.  ``most``
    bounds rates from above (1: no document is repeated) and targets by what there is.
    """
    k = len(domains)
    p = [F.col("mix_posterior")[i] for i in range(k)]
    sums = table.agg(*(F.sum(F.col("mix_tokens") * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(F.col("mix_tokens") * p[i]).alias(f"e{i}") for i in range(k))).first()
    have = np.array([sums[f"e{i}"] or 0.0 for i in range(k)])
    gram = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    tokens = have.sum()
    share = np.array([weights.get(d, 0.0) for d in domains])
    share = share / share.sum() if share.sum() > 0 else have / max(tokens, 1.0)
    if total is None:
        i = domains.index(anchor) if anchor in domains else -1
        total = have[i] / share[i] if i >= 0 and share[i] > 0 else tokens
    target = share * total
    if most is not None:
        target = np.minimum(target, have * most)
    inverse = np.linalg.pinv(gram + 1e-9 * max(np.trace(gram), 1.0) * np.eye(k))
    history: list[np.ndarray] = []
    reached, last = have, np.inf
    for _ in range(STEPS):
        rest = reached - target
        size = np.abs(rest).max() / max(tokens, 1.0)
        if size <= TOLERANCE or size > 0.9999 * last and len(history) > 5:
            break
        last = min(last, size)
        history.append(inverse @ rest)
        got = table.select("mix_tokens", "mix_posterior", rate_column(history, most).alias("r")).agg(*(F.sum(F.col("mix_tokens") * p[i] * F.col("r")).alias(f"e{i}") for i in range(k))).first()
        reached = np.array([got[f"e{i}"] or 0.0 for i in range(k)])
    rest = float(np.abs(reached - target).max() / max(tokens, 1.0)) if k else 0.0
    report = [{"domain": d, "available": float(a), "target": float(t), "expected": float(e), "steps": len(history), "rest": rest, "met": rest <= TOLERANCE} for d, a, t, e in zip(domains, have, target, reached, strict=True)]
    return rate_column(history, most), report


def mix(docs: DataFrame, labels: DataFrame, key: str, text: str, domain: Column, weights: dict[str, float], keep: tuple[str, ...] | None = None, **fit) -> tuple[DataFrame, list[str], list[dict]]:
    """(``keep``, mix_tokens, mix_posterior, mix_rate) of every document, the domains, and the report."""
    model = fit_classifier(docs, labels, key, text, domain)
    table = written(posteriors(docs, text, model, (key,) if keep is None else keep), "posteriors")
    rate, report = fit_rates(table, model.domains, weights, **fit)
    return table.withColumn("mix_rate", rate), model.domains, report


def draw(key: Column, seed: int = 23) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``seed`` alone."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
