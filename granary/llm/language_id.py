"""Language identification by a byte convolutional network.

Texts are lower-cased, ASCII non-letters become spaces, and the UTF-8 bytes are cut
into windows of fixed length (the last one filled with spaces).  Each window passes
byte embeddings, filters of several widths, max pooling over positions, and a softmax.
A document's probabilities are the mean over all its windows: whole texts, no prefix.

Training runs in numpy on the driver, on at most ``sample_rows`` labelled documents
(spread evenly over languages, at most ``windows_per_document`` windows of each), so
its memory is bounded whatever the corpus.  Scoring is one map over Arrow batches; the
embedding and filters are folded into tables by byte and by byte pair, which turns each
filter into one or two row lookups.

Defined results: null text, or text without a letter, is ``und`` with score 0; with no
labelled row to learn from every text is ``und``; ties go to the first language in
alphabetical order; repeated rows repeat; texts of any length are read whole, window by
window; columns ``keep`` come through, others are not read; an empty table gives an empty
result, and nothing to learn from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 96
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: More languages than this are refused, since counts by language come to the driver.
MOST_LANGUAGES = 1000

#: Byte to symbol: space and other ASCII 0, a-z 1 to 26, bytes from 0x80 on 27 and up.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[ord("a") : ord("z") + 1] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, 155)
SYMBOLS = 155


@dataclass
class Network:
    """Weights: embedding, one filter bank per width, and the softmax layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def _features(net: Network, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Pooled features of windows ``x`` (rows of symbols), and what the backward pass needs."""
    e = net.embedding[x]
    pooled, kept = [], []
    for w, k, b in zip(WIDTHS, net.filters, net.bias, strict=True):
        n = x.shape[1] - w + 1
        patch = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
        a = patch.reshape(-1, w * EMBEDDING) @ k + b
        a = a.reshape(len(x), n, -1)
        at = a.argmax(1)
        top = np.take_along_axis(a, at[:, None], 1)[:, 0]
        pooled.append(np.maximum(top, 0))
        kept.append((at, top))
    return np.concatenate(pooled, 1), kept


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on cross-entropy; the same rows in the same order give the same weights."""
    rng = np.random.default_rng(seed)
    scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    net = Network(languages, scale(SYMBOLS, EMBEDDING) * 4, [scale(w * EMBEDDING, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], scale(len(WIDTHS) * FILTERS, len(languages)), np.zeros(len(languages), np.float32))
    weights = [net.embedding, *net.filters, *net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights], 0
    share = np.bincount(labels, minlength=len(languages)) / max(1, len(labels))
    weight = (1 / np.maximum(share, 1e-9) / len(languages)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = windows[rows], labels[rows]
            f, kept = _features(net, x)
            p = _softmax(f @ net.out + net.out_bias)
            p[np.arange(len(y)), y] -= 1
            d = p * weight[y][:, None] / len(y)
            grads = [np.zeros_like(q) for q in weights]
            grads[-2], grads[-1] = f.T @ d, d.sum(0)
            df = d @ net.out.T
            for i, (w, (pos, top)) in enumerate(zip(WIDTHS, kept, strict=True)):
                g = df[:, i * FILTERS : (i + 1) * FILTERS] * (top > 0)
                symbols = np.stack([np.take_along_axis(x, pos + j, 1) for j in range(w)], 2)
                patch = net.embedding[symbols].reshape(len(x), FILTERS, w * EMBEDDING)
                grads[1 + i] += np.einsum("bfk,bf->kf", patch, g)
                grads[1 + len(WIDTHS) + i] += g.sum(0)
                back = (g[:, :, None] * net.filters[i].T[None]).reshape(len(x), FILTERS, w, EMBEDDING)
                np.add.at(grads[0], symbols.ravel(), back.reshape(-1, EMBEDDING))
            step += 1
            for q, g, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


class Scorer:
    """A network with embedding and filters folded into tables by symbol pair."""

    def __init__(self, net: Network):
        self.net = net
        self.tables = []
        for w, k in zip(WIDTHS, net.filters, strict=True):
            one = [net.embedding @ k[j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)]
            pairs = [(j, (one[j][:, None] + one[j + 1][None]).reshape(-1, FILTERS)) for j in range(0, w - 1, 2)]
            self.tables.append((w, pairs, [(w - 1, one[-1])] if w % 2 else []))

    def windows(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """Probabilities of windows, a block at a time."""
        out = np.empty((len(x), len(self.net.languages)), np.float32)
        for at in range(0, len(x), block):
            part = x[at : at + block]
            n, length = part.shape
            pair = part[:, :-1] * SYMBOLS + part[:, 1:]
            pooled = []
            for (w, pairs, single), b in zip(self.tables, self.net.bias, strict=True):
                m = length - w + 1
                a = None
                for j, t in pairs:
                    got = t.take(pair[:, j : j + m].ravel(), 0)
                    a = got if a is None else np.add(a, got, out=a)
                for j, t in single:
                    a += t.take(part[:, j : j + m].ravel(), 0)
                pooled.append(np.maximum(a.reshape(n, m, FILTERS).max(1) + b, 0))
            out[at : at + block] = _softmax(np.concatenate(pooled, 1) @ self.net.out + self.net.out_bias)
        return out

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities by document, and whether it has a letter at all."""
        texts = texts.fill_null("")
        lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        x, counts = cut(texts)
        p = self.windows(x)
        first = np.cumsum(counts) - counts
        total = np.add.reduceat(np.vstack([p, np.zeros((1, p.shape[1]), p.dtype)]).astype(np.float64), first) if len(counts) else np.zeros((0, p.shape[1]))
        return total / counts[:, None], lettered


def cut(texts: pa.Array, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as rows of symbols, and how many each text has (one at least)."""
    lowered = pc.utf8_lower(texts).cast(pa.large_string())
    offsets = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    data = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // length))
    flat = np.zeros(int(counts.sum()) * length, np.int64)
    start = (np.cumsum(counts) - counts) * length
    place = np.repeat(start - offsets[:-1], sizes) + np.arange(offsets[0], offsets[-1])
    flat[place] = SYMBOL[data[offsets[0] : offsets[-1]]]
    return flat.reshape(-1, length), counts


def _slices(array: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """Parts of ``array`` of about ``most`` bytes each, one text at least."""
    size = pc.binary_length(array).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(array):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield array.slice(at, stop - at)
        at = stop


def learn(df: DataFrame, key: str, text: str, lang: str, where: Column, sample_rows: int = 6000, windows_per_document: int = 4) -> Network | None:
    """A network trained on a bounded sample of rows with a language for which ``where`` holds."""
    labelled = df.filter(where & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(lang) != "und")).select(F.col(key).alias("k"), F.col(lang).alias("y"), F.col(text).alias("x"))
    counts = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy("y").limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return None
    each = max(1, sample_rows // len(counts))
    rate = F.coalesce(*(F.when(F.col("y") == F.lit(y), F.lit(min(1.0, each / n))) for y, n in counts.items()))
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, y, w = [], [], []
            for kk, yy, xx in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x, _ = cut(pa.array([xx.as_py()]))
                for i in np.unique(np.linspace(0, len(x) - 1, min(len(x), windows_per_document)).astype(int)):
                    k.append(kk)
                    y.append(yy)
                    w.append(x[i].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(k, batch.schema.field(0).type), pa.array(y, pa.string()), pa.array(w, pa.binary())], ["k", "y", "w"])

    picked = labelled.filter(draw < rate).mapInArrow(take, f"k {dict(df.dtypes)[key]}, y string, w binary")
    rows = picked.orderBy(F.xxhash64("k"), "k", "w").limit(2 * sample_rows * windows_per_document).collect()
    languages = sorted({r["y"] for r in rows})
    if not languages:
        return None
    x = np.frombuffer(b"".join(r["w"] for r in rows), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    return train(x, np.array([languages.index(r["y"]) for r in rows]), languages)


def predict(df: DataFrame, key: str, text: str, net: Network | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, ``keep``, lang_pred and score of every whole text."""
    types = dict(df.dtypes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        names = np.array([*(net.languages if net else []), "und"], dtype=object)
        for batch in batches:
            best, score = [], []
            for part in _slices(batch.column(1)):
                if scorer is None:
                    best += ["und"] * len(part)
                    score += [0.0] * len(part)
                    continue
                p, lettered = scorer.documents(part)
                best += list(names[np.where(lettered, p.argmax(1), len(names) - 1)])
                score += list(np.where(lettered, np.clip(p.max(1), 0, 1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(best, pa.string()), pa.array(score, pa.float64())], [key, *keep, "lang_pred", "score"])

    return df.select(key, text, *keep).mapInArrow(apply, ", ".join([*(f"`{k}` {types[k]}" for k in (key, *keep)), "lang_pred string", "score double"]))
