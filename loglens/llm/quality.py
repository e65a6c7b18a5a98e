"""Quality by supervised subword embeddings.

A document's features are its words, their character n-grams, the signs at the joints of words, and repetitions of the
word before, all hashed to buckets that have learnt vectors. A document is the mean of its features' vectors, a softmax over it gives the classes.
Vectors and output are fitted by numpy stochastic gradient descent on a bounded sample; executors compute the
sample's features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loglens.llm.common import as_batch, bytes_of, chunks
from loglens.llm.sampling import labelled

BITS, DIM, GRAMS = 16, 12, (2, 3, 4)
BUCKETS, REPEATED, ODD = 1 << BITS, 0, np.uint64(0x2545F4914F6CDD1D)
#: Bounds of the sample that is fitted: rows, and characters of a row.
TRAIN_DOCS, TRAIN_CHARS = 3_000, 100_000
THRESHOLD = 0.5

SCORED = "score double, predicted int"


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    return ((h ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def features(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of all features of a text, in a few arrays: n-grams of each length, words, joints, repetitions.

    Words keep their case and punctuation; a space at either end is part of their n-grams. A joint is the last two signs of a
    word and the first two of the next. An empty text has the n-grams of no word.
    """
    low = np.frombuffer(b" " + b" ".join(text.split()) + b" ", np.uint8)
    gap = low == 0x20
    gaps = np.cumsum(gap, dtype=np.int32)
    for n in GRAMS:
        size = len(low) - n + 1
        if size > 0:
            h = np.zeros(size, np.uint32)
            for k in range(n):
                h *= np.uint32(0x01000193)
                h ^= low[k : k + size]
            yield _mixed(h[gaps[n - 2 : n - 2 + size] == gaps[:size]].astype(np.uint64), n)
    at = np.flatnonzero(gap)
    if len(at) < 2 or len(low) < 3:
        return
    # Sums of signs times powers of an odd number; divided by the power at a word's begin, equal words are equal.
    power = np.full(len(low), ODD, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.cumsum(low * power, dtype=np.uint64)
    back = np.full(len(at) - 1, 1, np.uint64)
    base, shift = pow(int(ODD), -1, 1 << 64), at[:-1].astype(np.uint64)
    while shift.any():
        back = np.where(shift & np.uint64(1), back * np.uint64(base), back)
        base, shift = base * base % (1 << 64), shift >> np.uint64(1)
    words = (sums[at[1:] - 1] - sums[at[:-1]]) * back
    yield _mixed(words, 101)
    inner = at[1:-1]
    h = np.zeros(len(inner), np.uint64)
    for k in (-2, -1, 1, 2):
        h = h << np.uint64(8) | low[inner + k]
    yield _mixed(h, 102)
    same = int((words[1:] == words[:-1]).sum())
    yield np.full(same, REPEATED, np.uint64)


@dataclass
class Subwords:
    """A fitted model: a vector per bucket, and weights and bias of the two classes."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


class Scorer:
    """Scores texts. The mean vector's outputs are the mean of the vectors' outputs, so only these are looked up."""

    def __init__(self, model: Subwords):
        outputs = model.vectors.astype(np.float64) @ model.weights
        self.contrast = outputs[:, 1] - outputs[:, 0]  # a softmax of two needs their difference only
        self.bias = float(model.bias[1] - model.bias[0])

    def __call__(self, text: bytes) -> float:
        total, n = 0.0, 0
        for b in features(text):
            total += self.contrast[b].sum()
            n += len(b)
        return float(1 / (1 + np.exp(-np.clip(total / max(n, 1) + self.bias, -500, 500))))


def fit_docs(docs: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.5, seed: int = 7) -> Subwords:
    """SGD over (label, buckets, counts), one document a step, with a rate that falls to nothing."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    if not docs:
        return Subwords(vectors, weights, bias)
    share = (sum(d[0] for d in docs) + 0.5) / (len(docs) + 1)
    bias[1] = np.log(share / (1 - share))
    step, steps = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            y, b, n = docs[i]
            w = (n / n.sum()).astype(np.float32)
            h = w @ vectors[b]
            z = h @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= rate * (1 - step / steps)
            back = weights @ p
            weights -= np.outer(h, p)
            bias -= p
            # Frequent words shouldn't drown the rest: a vector's step goes with the root of its share.
            vectors[b] -= np.outer(np.sqrt(w), back)
            step += 1
    return Subwords(vectors, weights, bias)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [np.unique(np.concatenate([*features(x)]), return_counts=True) for x in bytes_of(batch.column("text"))]
        yield as_batch(
            {
                "y": batch.column("y"),
                "buckets": pa.array([b.astype("<u2").tobytes() for b, _ in own], pa.binary()),
                "counts": pa.array([n.astype("<u4").tobytes() for _, n in own], pa.binary()),
            }
        )


def fit(docs: DataFrame, labels: DataFrame, learn, limit: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Subwords:
    """Learns labels.quality of the ids for which learn(column) holds, from a bounded sample of them."""
    sample = labelled(docs, labels, "quality", learn, limit, max_chars)
    rows = sample.mapInArrow(_featured, "y int, buckets binary, counts binary").collect()
    found = [(r.y, np.frombuffer(r.buckets, "<u2").astype(np.int64), np.frombuffer(r.counts, "<u4")) for r in rows]
    return fit_docs(sorted(found, key=lambda d: (d[0], len(d[1]), d[1].tobytes(), d[2].tobytes())))


def score(docs: DataFrame, model: Subwords, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row, of its whole text. Null and empty texts are scored as the empty word.

    Equal texts get equal scores; null ids stay null. Other columns are ignored, also those named like results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as BUCKETS x DIM, for any input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = bytes_of(batch.column("text"))
            for a, b in chunks(texts):
                points = np.array([scorer(x) for x in texts[a:b]])
                yield as_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "score": pa.array(points, pa.float64()),
                        "predicted": pa.array((points >= threshold).astype("int32")),
                    }
                )

    inner = docs.select("doc_id", "text")
    return inner.mapInArrow(run, f"doc_id {inner.schema['doc_id'].dataType.simpleString()}, {SCORED}")
