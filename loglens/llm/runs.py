"""Runs of words that repeat with a period, by seeds on diagonals that are extended word by word.

A run is a longest stretch of consecutive words with smallest period q and a length of at least max(6, 4 q). Where it
lies on the diagonal of lag q (words q apart are identical), it covers length - q words: 5 for q = 1, and 3 * 2^j at
least for q in [2^j, 2^(j+1)), j > 0. So for each class of periods the k-grams of that guaranteed overlap are indexed:
k = 5, 6, 12, 24 and so on. As k is no smaller than any period of its class, a run's k-gram next occurs exactly one
period later: only pairs of successive occurrences in a document are enumerated, never all pairs, and whatever they
are extended to has no smaller period.

Pairs are extended along their diagonal. A table holds for each lag how far it is covered, so no stretch is
extended twice. Only positions whose k-gram occurs again get a place in the index of the next class, and documents of a
batch are indexed together, each ended by a sign of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loglens.llm.common import as_batch, bytes_of, chunks, mixed

#: Bytes of text whose words are indexed together.
STRETCH = 1 << 20
LEAST, TIMES = 6, 4

FOUND = (
    "n_words long, runs array<struct<start: long, length: long, period: long>>, "
    "top struct<start: long, length: long, period: long>, collapsed string"
)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Numbers for the rows of columns, equal for equal rows."""
    out = columns[0]
    for c in columns[1:]:
        out = np.unique(out.astype(np.int64) << 32 | c, return_inverse=True)[1]
    return out


def _again(rank: np.ndarray) -> np.ndarray:
    """Mask of the values that occur more than once."""
    return np.bincount(rank)[rank] > 1


def _repeated(ids: np.ndarray, k: int) -> np.ndarray:
    """Positions whose k-gram might occur again, by hashes: all that do, and hardly any that doesn't."""
    size = len(ids) - k + 1
    if size <= 1:
        return np.zeros(0, np.int64)
    words = mixed(ids.astype(np.uint64) + np.uint64(1))
    h = words[:size].copy()
    for i in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[i : i + size]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    found = np.zeros(size, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return np.flatnonzero(found)


def _index(ids: np.ndarray, document: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(least period, k, positions, ranks of k-grams) for each class of periods; only k-grams that a document repeats."""
    k, at = LEAST - 1, _repeated(ids, LEAST - 1)
    rank = _ranks(document[at], *(ids[at + i] for i in range(k)))
    period = 1
    while len(at):
        some = _again(rank)
        at, rank = at[some], rank[some]
        yield period, k, at, rank
        # The next k-grams consist of two of these, one behind or over the other.
        longer = LEAST if period == 1 else 2 * k
        of = np.full(len(ids) + longer, -1, np.int64)
        of[at] = rank
        second = of[at + longer - k]
        some = second >= 0
        at, rank = at[some], _ranks(rank[some], second[some])
        k, period = longer, 2 * period


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many values from the start on are equal."""
    done, size, n = 0, 64, min(len(a), len(b))
    while done < n:
        differ = a[done : done + size] != b[done : done + size][: n - done]
        if differ.any():
            return done + int(differ.argmax())
        done, size = min(done + size, n), 4 * size
    return n


def find(ids: np.ndarray, document: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs. Each document's words are followed by an id that occurs nowhere else."""
    found = []
    for least, k, at, rank in _index(ids, document):
        order = np.argsort(rank, kind="stable")
        lag = np.diff(at[order])
        pair = np.flatnonzero((rank[order[1:]] == rank[order[:-1]]) & (lag >= least) & (lag < 2 * least))
        if not len(pair):
            continue
        seed, lag = at[order[:-1]][pair], lag[pair]
        order = np.lexsort((seed, lag))
        seed, lag = seed[order], lag[order]
        # Neighbouring seeds of a lag are one stretch already.
        first = np.flatnonzero(np.concatenate([[True], (lag[1:] != lag[:-1]) | (seed[1:] != seed[:-1] + 1)]))
        last = np.concatenate([first[1:], [len(seed)]]) - 1
        covered: dict[int, int] = {}
        for a, b, d in zip(seed[first].tolist(), seed[last].tolist(), lag[first].tolist()):
            if a < covered.get(d, 0):
                continue
            begin, end = a, b + k
            end += _reach(ids[end : len(ids) - d], ids[end + d :])
            begin -= _reach(ids[:begin][::-1], ids[d : begin + d][::-1])
            covered[d] = end
            if end - begin + d >= max(LEAST, TIMES * d):
                found.append((begin, end - begin + d, d))
    return found


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs as (start, length, period), by start and then period."""
    number = _Numbers()
    ids, begin = [], [0]
    for t, words in enumerate(texts):
        ids += [number[w] for w in words]
        ids.append(-1 - t)
        begin.append(len(ids))
    all_ids = np.array(ids, np.int64)
    all_ids[all_ids < 0] = len(number) - 1 - all_ids[all_ids < 0]
    document = np.repeat(np.arange(len(texts)), np.diff(begin))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in find(all_ids, document):
        t = int(document[start])
        out[t].append((start - begin[t], length, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length/period, compared exactly; of equal ones the first, then that of the smallest period."""
    top = None
    for r in runs:  # by start and period
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, top, collapsed) of every row: all runs of its text, the one with most periods, the rest.

    Words are parted by ASCII white space and compared as they are. runs are ordered by start and period; top is null
    where there is none. collapsed is the text without what runs repeat, joined by single spaces. prepare(doc_id,
    words) may change a text's words first. Null and empty texts have no words, no runs and an empty rest. A very long
    text is indexed alone, as a whole. Equal rows get equal results, null ids stay null. Other columns are ignored, also
    those named like results.
    """
    inner = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b in chunks(texts, STRETCH):
                words = [x.split() for x in texts[a:b]]
                if prepare is not None:
                    words = [prepare(i, w) for i, w in zip(ids.slice(a, b - a).to_pylist(), words, strict=True)]
                runs = runs_of(words)
                shown = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs]
                tops = [None if r is None else dict(zip(("start", "length", "period"), r)) for r in map(best, runs)]
                yield as_batch(
                    {
                        "doc_id": ids.slice(a, b - a),
                        "n_words": pa.array([len(w) for w in words], pa.int64()),
                        "runs": pa.array(shown, pa.list_(RUN)),
                        "top": pa.array(tops, RUN),
                        "collapsed": pa.array([b" ".join(kept(w, r)) for w, r in zip(words, runs)], pa.binary()).cast(pa.string()),
                    }
                )

    return inner.mapInArrow(run, f"doc_id {inner.schema['doc_id'].dataType.simpleString()}, {FOUND}")
