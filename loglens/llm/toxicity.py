"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag is labelled. A sentence's probability is a logistic function
of the distinct character n-grams of its words, hashed to buckets. The document's is their noisy-or with a leak for
labels that no sentence explains:

    P(document) = 1 - (1 - leak) * product over sentences of (1 - p(sentence))

Executors count in how many learning documents of either class a bucket occurs; the few buckets that are clearly more
common in toxic ones get weights, fitted by numpy gradient descent on the document labels alone. The fitted sentence
scores say where the offence is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import WORD_BYTES, as_batch, bytes_of, chunks, written
from loglens.llm.sampling import labelled

BITS, GRAMS = 20, (4, 5, 6)
#: Bounds of the sample that is fitted: rows, and characters of a row.
TRAIN_DOCS, TRAIN_CHARS = 12_000, 200_000
#: Learning documents that must hold a bucket's n-gram for it to have a weight, by how many standard deviations more of
#: them than usual must be toxic, and how many buckets have weights at most.
MIN_DOCS, MIN_LIFT, MAX_WEIGHTS = 5, 5.0, 4096
THRESHOLD, SENTENCE_THRESHOLD = 0.3, 0.5
#: Bytes of text that are scored in one go.
STRETCH = 1 << 20

SENTENCE_END = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))
WIDE_END = re.compile(b"\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")  # full-width signs, replaced by as many bytes

SCORED = "score double, predicted int, n_sentences long, offending array<struct<sentence: long, score: double, text: string>>"


class Stretch:
    """Texts as one array of bytes: sentences, the texts they belong to, and the buckets of n-grams in them."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n" + b"\n".join(texts) + b"\n"
        self.raw = WIDE_END.sub(b"  .", joined)
        self.low = np.frombuffer(self.raw.translate(WORD_BYTES), np.uint8)
        gap = self.low == 0x20
        self.sentence = np.cumsum(SENTENCE_END[np.frombuffer(self.raw, np.uint8)], dtype=np.int32)  # an end opens the next one
        self.gaps = np.cumsum(gap, dtype=np.int32)
        starts = np.cumsum([1] + [len(x) + 1 for x in texts])
        self.first = self.sentence[starts - 1]  # of each text, and behind the last
        self.full = np.zeros(self.sentence[-1] + 1, bool)
        self.full[self.sentence[~gap]] = True  # sentences that hold any word
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.text_of = np.concatenate([np.full(self.first[0], -1), self.text_of, np.full(len(self.full) - self.first[-1], -1)])

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, buckets) of the n-grams of words for each n; the space at either end of a word is part of it."""
        for n in GRAMS:
            size = len(self.low) - n + 1
            if size <= 0:
                continue
            h = np.full(size, n, np.uint32)
            for k in range(n):
                h *= np.uint32(0x01000193)
                h ^= self.low[k : k + size]
            h *= np.uint32(0x9E3779B1)
            at = np.flatnonzero(self.gaps[n - 2 : n - 2 + size] == self.gaps[:size])
            yield at, h[at] >> np.uint32(32 - BITS)

    def hits(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (sentence, bucket) of n-grams in wanted buckets, a mask."""
        own = [np.zeros(0, np.int64)]
        for at, b in self.grams():
            hit = np.flatnonzero(wanted[b])
            own.append((self.sentence[at[hit] + 1].astype(np.int64) << BITS) | b[hit])
        pairs = np.unique(np.concatenate(own))
        return pairs >> BITS, pairs & ((1 << BITS) - 1)

    def sentences(self, text: int) -> np.ndarray:
        own = np.arange(self.first[text], self.first[text + 1])
        return own[self.full[own]]

    def shown(self, sentence: int) -> str:
        a, b = np.searchsorted(self.sentence, [sentence, sentence + 1])
        return self.raw[a + 1 : b].strip().decode(errors="replace")


@dataclass
class NoisyOr:
    """A fitted model: weights of the few buckets that have one, the sentences' bias and the leak."""

    weights: dict[int, float]
    bias: float
    leak: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[list(self.weights)] = list(self.weights.values())
        return out

    def score(self, texts: list[bytes], dense: np.ndarray, threshold: float = SENTENCE_THRESHOLD) -> tuple[np.ndarray, np.ndarray, list]:
        """Probabilities of the texts, numbers of sentences, and for each text (number, probability, text) of offending ones."""
        s = Stretch(texts)
        sentence, b = s.hits(dense != 0)
        z = np.bincount(sentence, dense[b], len(s.full)) + self.bias
        of = np.flatnonzero(s.full)
        n = np.bincount(s.text_of[of], minlength=len(texts))
        clean = np.bincount(s.text_of[of], -np.logaddexp(0, z[of]), len(texts)) + np.log1p(-self.leak)
        offending: list[list] = [[] for _ in texts]
        cut = np.log(threshold / (1 - threshold))
        for i in of[z[of] >= cut]:
            t = s.text_of[i]
            number = int(s.full[s.first[t] : i].sum())
            offending[t].append((number, float(1 / (1 + np.exp(-z[i]))), s.shown(i)))
        return -np.expm1(clean), n, offending


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many documents, and toxic ones, a bucket occurs."""
    n, toxic = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for batch in batches:
        for text, y in zip(bytes_of(batch.column("text")), batch.column("y").to_pylist(), strict=True):
            own = np.unique(np.concatenate([np.zeros(0, np.uint32), *(b for _, b in Stretch([text]).grams())]))
            n[own] += 1
            toxic[own] += y
    names = np.flatnonzero(n)
    yield as_batch({"bucket": pa.array(names, pa.int64()), "n": pa.array(n[names]), "n_toxic": pa.array(toxic[names])})


def informative(sample: DataFrame, limit: int = MAX_WEIGHTS) -> list[int]:
    """The buckets that are clearly more common in toxic documents, at most limit of them."""
    sums = sample.agg(F.count("*").alias("n"), F.sum("y").alias("n_toxic")).first()
    share = (sums.n_toxic or 0) / max(sums.n, 1)
    if not 0 < share < 1:
        return []
    lift = (F.col("n_toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    counted = sample.mapInArrow(_counts, "bucket long, n int, n_toxic int").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    chosen = counted.where(F.col("n") >= MIN_DOCS).withColumn("lift", lift).where(F.col("lift") >= MIN_LIFT)
    return [r.bucket for r in chosen.orderBy(F.desc("lift"), "bucket").limit(limit).collect()]


def bags_of(sample: DataFrame, wanted: list[int]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(label, number of sentences, buckets, sizes) of each sampled document, with the wanted buckets only."""
    chosen = np.zeros(1 << BITS, bool)
    chosen[wanted] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words, sizes = [], [], []
            for text in bytes_of(batch.column("text")):
                s = Stretch([text])
                sentence, b = s.hits(chosen)
                n.append(int(s.full.sum()))
                words.append(b.astype("<u4").tobytes())
                sizes.append(np.unique(sentence, return_counts=True)[1].astype("<u4").tobytes())
            yield as_batch(
                {"y": batch.column("y"), "n": pa.array(n, pa.int64()), "words": pa.array(words, pa.binary()), "sizes": pa.array(sizes, pa.binary())}
            )

    rows = sample.mapInArrow(run, "y int, n long, words binary, sizes binary").collect()
    out = [(r.y, r.n, np.frombuffer(r.words, "<u4"), np.frombuffer(r["sizes"], "<u4")) for r in rows]
    return sorted(out, key=lambda b: (b[0], b[1], b[2].tobytes()))


def fit_bags(bags: list[tuple[int, int, np.ndarray, np.ndarray]], epochs: int = 300, rate: float = 0.1, l1: float = 1.0) -> NoisyOr:
    """Full-batch Adam on the log likelihood of the labels; without bags, or with one class only, a leak alone."""
    y = np.array([b[0] for b in bags], float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not len(bags) or y.min(initial=1) == y.max(initial=0):
        return NoisyOr({}, -12.0, float(share))
    words = np.concatenate([b[2] for b in bags]).astype(np.int64)
    sizes = np.concatenate([b[3] for b in bags]).astype(np.int64)
    own = np.array([len(b[3]) for b in bags])
    others = np.array([b[1] for b in bags]) - own  # sentences without weights
    doc_of = np.repeat(np.arange(len(bags)), own)
    sentence_of = np.repeat(np.arange(len(sizes)), sizes)
    names, at = np.unique(words, return_inverse=True)

    n = len(names)
    x = np.concatenate([np.zeros(n), [-6.0, -4.0]])  # weights, bias, logit of the leak
    m, v = np.zeros(n + 2), np.zeros(n + 2)
    for t in range(1, epochs + 1):
        z = np.bincount(sentence_of, x[at], len(sizes)) + x[n]
        p, base, leak = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-x[n])), 1 / (1 + np.exp(-x[n + 1]))
        clean = np.bincount(doc_of, -np.logaddexp(0, z), len(bags)) - others * np.logaddexp(0, x[n]) + np.log1p(-leak)
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        pull = np.where(y > 0, (1 - toxic) / toxic, -1.0) / len(bags)  # d log likelihood / d z is p times this
        by_sentence = p * pull[doc_of]
        g = np.empty(n + 2)
        g[:n] = np.bincount(at, by_sentence[sentence_of], n) - l1 / len(bags) * np.sign(x[:n])
        g[n], g[n + 1] = by_sentence.sum() + base * (pull * others).sum(), leak * pull.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x += rate * 0.993**t * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    keep = np.flatnonzero(np.abs(x[:n]) > 0.01)
    return NoisyOr({int(names[i]): float(x[i]) for i in keep}, float(x[n]), float(1 / (1 + np.exp(-x[n + 1]))))


def fit(docs: DataFrame, labels: DataFrame, learn, limit: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> NoisyOr:
    """Learns labels.toxic of the ids for which learn(column) holds, from a bounded sample of them."""
    sample = written(labelled(docs, labels, "toxic", learn, limit, max_chars), "toxic-sample")
    return fit_bags(bags_of(sample, informative(sample)))


def score(docs: DataFrame, model: NoisyOr, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score, predicted, number of sentences and the offending sentences.

    The whole text is scored. Null and empty texts have no sentence and get the leak as score. Equal texts get equal
    scores; a null doc_id stays null. Other columns are ignored, also those named like results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            texts = bytes_of(batch.column("text"))
            for a, b in chunks(texts, STRETCH):
                points, n, offending = model.score(texts[a:b], dense)
                kind = pa.list_(pa.struct([("sentence", pa.int64()), ("score", pa.float64()), ("text", pa.string())]))
                yield as_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "score": pa.array(points, pa.float64()),
                        "predicted": pa.array((points >= threshold).astype(np.int32), pa.int32()),
                        "n_sentences": pa.array(n, pa.int64()),
                        "offending": pa.array(offending, kind),
                    }
                )

    inner = docs.select("doc_id", "text")
    return inner.mapInArrow(run, f"doc_id {inner.schema['doc_id'].dataType.simpleString()}, {SCORED}")


def without_toxic(docs: DataFrame, model: NoisyOr, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns and in whole."""
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            texts = bytes_of(batch.column(text))
            for a, b in chunks(texts, STRETCH):
                yield batch.slice(a, b - a).filter(pa.array(model.score(texts[a:b], dense)[0] < threshold))

    return inner.mapInArrow(run, inner.schema).toDF(*names)
