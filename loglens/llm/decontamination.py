"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item's windows are its runs of so many words; a shorter item is one window. A window occurs in a document
if all its shingles occur there, in order: a set join with containment 1. So one shingle of the window, the rarest
one in the corpus, is the whole necessary prefix. Documents are matched on prefix shingles only, of which rare ones
give few candidates. A candidate must then leave room for the window before and behind the shingle (positional and
length bounds), and its words must equal the window's.

Windows live in blocks of bounded size: arrays in the shared folder that workers map into memory, one block after
another, so the benchmark may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import WordHash, as_batch, bytes_of, chunks, fresh, hashed, local_path, mixed, plain_words, save_array, written

WINDOW, SHINGLE = 10, 4
#: Windows of a block, and text that a task handles at once.
BLOCK_WINDOWS, STRETCH = 1 << 18, 1 << 20


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, from the words' hashes."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = mixed(out ^ words[k : k + size])
    return out


def _windows(width: int, shingle: int):
    """Of each item its distinct windows: their words, number of words, and shingles in order of place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            items, texts = batch.column("item").to_pylist(), bytes_of(batch.column("text"))
            rows: list[tuple] = []
            for item, text in zip(items, texts, strict=True):
                words = plain_words(text)
                size = min(width, len(words))
                for w in {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else ():
                    rows.append((item, b" ".join(w), size, shingle_hashes(hashed(w, cache, size), min(shingle, size)).view(np.int64)))
            for a in range(0, len(rows), 10_000) if rows else ():
                part = rows[a : a + 10_000]
                yield as_batch(
                    {
                        "item": pa.array([r[0] for r in part], pa.string()),
                        "words": pa.array([r[1] for r in part], pa.binary()),
                        "size": pa.array([r[2] for r in part], pa.int32()),
                        "shingles": pa.array([r[3] for r in part], pa.list_(pa.int64())),
                    }
                )

    return run


def _sorted_blocks(spark, hashes: DataFrame, name: str) -> list[str]:
    """Paths of sorted arrays of distinct hashes, written block by block."""
    n = hashes.count()
    blocks = max(1, -(-n // (4 * BLOCK_WINDOWS)))
    folder, out = fresh(spark, name), []
    for k in range(blocks if n else 0):
        own = hashes.where(F.pmod("h", F.lit(blocks)) == k).toArrow().column("h").to_numpy()
        save_array(path := f"{local_path(folder)}/{k}.npy", np.sort(own.view(np.uint64)))
        out.append(path)
    return out


def rarity(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(h, n): how often each shingle of the benchmark (h) occurs in the documents, if at all."""
    paths = _sorted_blocks(docs.sparkSession, shingles, "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, tables = WordHash(), [np.load(p, mmap_mode="r") for p in paths]
        counts = [np.zeros(len(t), np.int64) for t in tables]
        for batch in batches:
            texts = bytes_of(batch.column("text"))
            for a, b in chunks(texts, STRETCH):
                words, bound = _flat(texts[a:b], cache)[1:]
                for n in sizes:
                    h = shingle_hashes(words, n)
                    h = h[np.repeat(bound[1:], np.diff(bound))[: len(h)] >= np.arange(n, n + len(h))]  # within one text
                    for t, c in zip(tables, counts, strict=True):
                        at = np.searchsorted(t, h)
                        at[at == len(t)] = 0
                        c += np.bincount(at[t[at] == h], minlength=len(t))
        for t, c in zip(tables, counts, strict=True):
            hit = np.flatnonzero(c)
            yield as_batch({"h": pa.array(t[hit].view(np.int64)), "n": pa.array(c[hit])})

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _flat(texts: list[bytes], cache: dict) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words of the texts, their hashes, and where each text begins and the last ends."""
    words, bound = [], [0]
    for x in texts:
        words += plain_words(x)
        bound.append(len(words))
    return words, hashed(words, cache, len(words)), np.array(bound)


def packed_ids(ids: list[str]) -> bytes:
    """Each id behind its size, so ids may hold anything."""
    raw = [x.encode() for x in ids]
    return b"".join(len(x).to_bytes(4, "little") + x for x in raw)


def unpacked_ids(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at : at + 4], "little")
        yield data[at + 4 : end]
        at = end


class Block:
    """A block of windows: sorted prefix shingles, and of each the window's size, the shingle's place in it, words, items."""

    def __init__(self, path: str):
        self.h, self.n, self.size, self.place, self.words_end, self.items_end = (
            np.load(f"{path}/{x}.npy", mmap_mode="r") for x in ("h", "n", "size", "place", "words_end", "items_end")
        )
        self.words, self.items = (np.load(f"{path}/{x}.npy", mmap_mode="r") for x in ("words", "items"))
        self.sizes = [int(x) for x in np.unique(self.n)]

    def slot(self, data: np.ndarray, end: np.ndarray, i: int) -> bytes:
        return data[end[i - 1] if i else 0 : end[i]].tobytes()


def build(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, shingle: int = SHINGLE) -> list[str]:
    """Paths of the benchmark's blocks of windows, each under its rarest shingle in the documents."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    windows = items.mapInArrow(_windows(width, shingle), "item string, words binary, size int, shingles array<long>")
    windows = written(windows.groupBy("words", "size", "shingles").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")
    n = windows.count()
    if not n:
        return []
    sizes = [r[0] for r in windows.select(F.least("size", F.lit(shingle))).distinct().collect()]  # at most shingle of them
    placed = windows.select("*", F.xxhash64("words").alias("w"), F.posexplode("shingles").alias("place", "h"))
    seen = rarity(docs, placed.select("h").distinct(), sizes)
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "place")).alias("best")
    # A shingle that many windows share may be hot; its count is joined, never its windows gathered.
    chosen = placed.join(seen, "h", "left").groupBy("words", "size", "items").agg(best)
    chosen = written(chosen.select("words", "size", "items", "best.h", "best.place", (F.abs(F.xxhash64("words")) % -(-n // BLOCK_WINDOWS)).alias("block")), "prefixes")
    folder, out = local_path(fresh(spark, "blocks")), []
    for k in range(-(-n // BLOCK_WINDOWS)):
        own = chosen.where(F.col("block") == k).toArrow()
        h = own.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        size = own.column("size").to_numpy()[order]
        words = [own.column("words")[int(i)].as_py() for i in order]
        ids = [packed_ids(own.column("items")[int(i)].as_py()) for i in order]
        for name, values in (
            ("h", h[order]),
            ("n", np.minimum(size, shingle)),
            ("size", size),
            ("place", own.column("place").to_numpy()[order]),
            ("words", np.frombuffer(b"".join(words), np.uint8)),
            ("words_end", np.cumsum([len(x) for x in words])),
            ("items", np.frombuffer(b"".join(ids), np.uint8)),
            ("items_end", np.cumsum([len(x) for x in ids])),
        ):
            save_array(f"{folder}/{k}/{name}.npy", values)
        out.append(f"{folder}/{k}")
    return out


def _found(texts: list[bytes], blocks: list[Block], cache: dict) -> tuple[np.ndarray, np.ndarray, list[set[bytes]]]:
    """Of each text: number of words, words inside occurrences of windows, and the items with occurring windows."""
    words, hashes, bound = _flat(texts, cache)
    n_words = np.diff(bound)
    text_of = np.repeat(np.arange(len(texts)), n_words)
    cover = np.zeros(len(words) + 1, np.int64)
    items: list[set[bytes]] = [set() for _ in texts]
    for block in blocks:
        for n in block.sizes:
            h = shingle_hashes(hashes, n)
            low = np.searchsorted(block.h, h)
            low[low == len(block.h)] = 0
            for p in np.flatnonzero(block.h[low] == h):
                t = text_of[p]
                i = int(low[p])
                while i < len(block.h) and block.h[i] == h[p]:
                    a, size = int(p - block.place[i]), int(block.size[i])
                    # Both bounds come before the words are looked at.
                    if block.n[i] == n and a >= bound[t] and a + size <= bound[t + 1]:
                        if b" ".join(words[a : a + size]) == block.slot(block.words, block.words_end, i):
                            cover[a] += 1
                            cover[a + size] -= 1
                            items[t].update(unpacked_ids(block.slot(block.items, block.items_end, i)))
                    i += 1
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return n_words, hit[bound[1:]] - hit[bound[:-1]], items


def scan(docs: DataFrame, blocks: list[str]) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row; items are the sorted ids of items with occurring windows.

    Null and empty texts have no words; without a benchmark nothing is hit. Windows may overlap and repeat; each word
    counts once. Rows with null or repeated ids are rows like others. Windows of items without an id are hit as others
    are, but name no item. A very long text is handled alone, as a whole. Other columns are ignored, also those named
    like results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, opened = WordHash(), [Block(p) for p in blocks]
        for batch in batches:
            texts = bytes_of(batch.column("text"))
            for a, b in chunks(texts, STRETCH):
                n_words, n_hit, items = _found(texts[a:b], opened, cache)
                yield as_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "n_words": pa.array(n_words, pa.int64()),
                        "n_hit": pa.array(n_hit, pa.int64()),
                        "items": pa.array([sorted(x.decode() for x in s) for s in items], pa.list_(pa.string())),
                    }
                )

    inner = docs.select("doc_id", "text")
    return inner.mapInArrow(run, f"doc_id {inner.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    return scan(docs, build(docs, benchmark, width, shingle))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The documents that hold no window of any item, with all their columns and in whole."""
    blocks = build(docs, benchmark, width, shingle)
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, opened = WordHash(), [Block(p) for p in blocks]
        for batch in batches:
            texts = bytes_of(batch.column(text))
            for a, b in chunks(texts, STRETCH):
                yield batch.slice(a, b - a).filter(pa.array(_found(texts[a:b], opened, cache)[1] == 0))

    return inner.mapInArrow(run, inner.schema).toDF(*names)
