"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams, of all lengths of a blended spectrum, that are present in
both, divided by the root of what each has. Nyström landmarks, some learning texts of each language, turn it into
features: kernel values with the landmarks times the inverse root of the landmarks' own kernel matrix. Kernel ridge
regression in these features, one language versus the rest, gives a value per language; the greatest one decides, and
a softmax over them is the score.

n-grams are hashed to buckets, and buckets that only one landmark has, or beyond the most frequent COLUMNS, are left out
of the kernel. A batch of texts is a matrix of zeros and ones, so scoring it is a product with the landmarks' matrix,
and one with the languages' weights. Only text goes in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import as_batch, chunks

GRAMS, BITS, COLUMNS = (1, 2, 3, 4), 18, 8192
LANDMARKS, RIDGE, SHARPNESS = 384, 1e-3, 6.0
#: Bounds of the sample that is fitted: rows of all languages together, and characters of a row.
TRAIN_DOCS, TRAIN_CHARS = 3000, 20_000
#: Texts of a matrix product, and bytes of text in it.
ROWS, STRETCH = 64, 1 << 18
UNKNOWN = "und"

LETTER = regex.compile(r"\p{L}")


def characters(text: str) -> np.ndarray:
    """Lowered, with one blank for each white space and at both ends; digits are alike."""
    shown = " " + " ".join(text.lower().split()) + " "
    points = np.frombuffer(shown.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((points >= 48) & (points <= 57), np.uint32(48), points)


def buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of texts, buckets) of all n-grams, length by length."""
    own = [characters(t) for t in texts]
    points = np.concatenate([np.zeros(0, np.uint32), *own])
    of = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])
    for n in GRAMS:
        size = len(points) - n + 1
        if size > 0:
            h = np.full(size, n, np.uint32)
            for k in range(n):
                h *= np.uint32(0x01000193)
                h ^= points[k : k + size]
            h *= np.uint32(0x9E3779B1)
            inside = of[n - 1 :] == of[:size]
            yield of[:size][inside], (h >> np.uint32(32 - BITS))[inside]


def presence(texts: list[str], column: np.ndarray, width: int) -> np.ndarray:
    """A row of zeros and ones for each text. column: of a bucket, width for those that have none."""
    out = np.zeros((len(texts), width + 1), np.float32)
    for row, bucket in buckets(texts):
        out[row, column[bucket]] = 1
    return out[:, :width]


def normed(x: np.ndarray) -> np.ndarray:
    """Rows divided by the root of what they have, so their products are kernel values."""
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


@dataclass
class Kernel:
    """A fitted model: columns of buckets, normed landmarks, the languages' weights over them, and biases."""

    column: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    langs: list[str]

    def margins(self, texts: list[str]) -> np.ndarray:
        x = normed(presence(texts, self.column, self.landmarks.shape[1]))
        return (x @ self.landmarks.T) @ self.weights + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)] if self.langs else []
        langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known:
            z = SHARPNESS * self.margins([texts[i] for i in known]).astype(np.float64)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, best, s in zip(known, p.argmax(1), p.max(1)):
                langs[i], score[i] = self.langs[best], s
        return langs, score


def fit_texts(rows: list[tuple[str, str]], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Kernel:
    """Fits (language, text) rows. Landmarks are the first rows of each language, as many of each."""
    langs = sorted({x for x, _ in rows})
    empty = np.zeros(1 << BITS, np.int32)
    if not langs:
        return Kernel(empty, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), [])
    each = -(-n_landmarks // len(langs))
    chosen = [[i for i, r in enumerate(rows) if r[0] == x][:each] for x in langs]
    marks = [rows[i][1] for own in chosen for i in own]

    found = np.zeros(1 << BITS, np.int64)
    for t in marks:
        found[np.unique(np.concatenate([b for _, b in buckets([t])]))] += 1
    order = np.lexsort((np.arange(len(found)), -found))[:COLUMNS]
    order = order[found[order] >= min(2, len(marks))]
    column = np.full(1 << BITS, len(order), np.int32)
    column[order] = np.arange(len(order))

    m = normed(presence(marks, column, len(order)))
    kernel = np.concatenate([normed(presence([t for _, t in rows[a : a + ROWS]], column, len(order))) @ m.T for a in range(0, len(rows), ROWS)])
    value, vector = np.linalg.eigh((m @ m.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    # Rows of a language weigh as much as those of any other.
    y = np.array([[1.0 if x == own else -1.0 for x in langs] for own, _ in rows])
    share = {x: sum(own == x for own, _ in rows) for x in langs}
    w = np.array([len(rows) / len(langs) / share[own] for own, _ in rows])
    features = np.concatenate([kernel.astype(np.float64) @ root, np.ones((len(rows), 1))], 1)
    penalty = np.eye(features.shape[1]) * ridge * len(rows)
    penalty[-1, -1] = 0
    solved = np.linalg.lstsq(features.T @ (w[:, None] * features) + penalty, features.T @ (w[:, None] * y), rcond=None)[0]
    return Kernel(column, m, (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32), langs)


def sample(docs: DataFrame, learn: Callable[[Column], Column], limit: int, max_chars: int) -> DataFrame:
    """(lang, text) of at most limit learning rows, of each language as many or all it has, in the order of a hash.

    Null languages, null texts, texts without a letter and texts of more than max_chars characters aren't learnt from. A
    language's rows are thinned by their hash before they are ranked, so no task ranks all of them.
    """
    own = docs.where(learn(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") <= max_chars) & F.col("text").rlike(r"\p{L}"))
    own = own.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("_h"))
    sizes = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}  # a row per language
    each = max(limit // max(len(sizes), 1), 1)
    upto = {x: min(1.0, (2 * each + 100) / n) for x, n in sizes.items()}
    share = docs.sparkSession.createDataFrame(list(upto.items()), "lang string, share double")
    thin = own.join(F.broadcast(share), "lang").where((F.col("_h") / 2.0**64 + 0.5) <= F.col("share"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text"))
    return thin.withColumn("_n", order).where(F.col("_n") <= each).select("lang", "text", "_h")


def fit(docs: DataFrame, learn: Callable[[Column], Column], limit: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Kernel:
    """Learns lang of text for the ids for which learn(column) holds, from a bounded sample of them."""
    rows = sorted((r.lang, r["_h"], r.text) for r in sample(docs, learn, limit, max_chars).collect())
    return fit_texts([(lang, text) for lang, _, text in rows])


def score(docs: DataFrame, model: Kernel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, of its whole text.

    lang_pred is a learnt language; `und`, with score 0, if the text is null or has no letter, or if nothing was learnt.
    Equal texts get equal results, up to the rounding of sums; of equal margins the first language in order counts.
    A long text is one row of its matrix like any other. Null ids stay null. Other columns are ignored, also those named
    like results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks([t or "" for t in texts], STRETCH):
                for c in range(a, b, ROWS):
                    langs, scores = model.predict(texts[c : min(c + ROWS, b)])
                    yield as_batch(
                        {"doc_id": batch.column("doc_id").slice(c, len(langs)), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores)}
                    )

    inner = docs.select("doc_id", "text")
    return inner.mapInArrow(run, f"doc_id {inner.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
