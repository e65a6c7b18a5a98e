"""Near-duplicates by SimHash fingerprints, compared through pivot distance tables.

1. A fingerprint of 64 bits per document, from all its word shingles.
2. Distinct fingerprints that differ in at most d bits agree on at least b - d of b blocks of bits. Each fingerprint
   takes one key per choice of b - d blocks, so linked ones share a bucket and no link is lost. b grows with the
   number of fingerprints, which keeps buckets small.
3. Within a bucket, Hamming distances of its members to a set of reference fingerprints (pivots) are computed once. By
   the triangle inequality a pair whose distances to any pivot differ by more than d can't be linked, so most pairs are
   discarded by their largest coordinate difference; only the rest are compared bit by bit.
4. A bucket of more than BUCKET fingerprints is not compared: its members get finer keys, on the bits its key leaves
   open, in another round, until no bucket is too large.
5. Links reduce to trees before they leave a task, and connected components join them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import as_batch, bytes_of, mixed, popcount, spaced_words, written
from loglens.llm.components import components

BITS, SHINGLE, SEED, DISTANCE = 64, 4, 42, 4
#: Reference fingerprints.
PIVOTS = mixed(np.arange(1, 25, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Largest bucket that is compared as it is; fingerprints that are compared at once.
BUCKET, ROWS = 4096, 1 << 18
#: Shingles whose hashes are in memory at once.
SHINGLES = 1 << 17


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes; repeats count. No words: 0."""
    words = spaced_words(text)
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    first, last = starts[:n].tolist(), (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, SHINGLES):
        own = [digest(joined[a:b], SEED) for a, b in zip(first[i : i + SHINGLES], last[i : i + SHINGLES])]
        bits = np.unpackbits(np.array(own, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is a long with the fingerprint's bits. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [fingerprint(x, shingle) for x in bytes_of(batch.column("text"))]
            yield as_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(own, np.uint64).view(np.int64))})

    inner = docs.select("doc_id", "text")
    return inner.mapInArrow(run, f"doc_id {inner.schema['doc_id'].dataType.simpleString()}, fp long")


def blocks_for(n: int, bits: int = BITS, distance: int = DISTANCE, least: int = 7) -> int:
    """The fewest blocks with which n evenly spread fingerprints meet less than one other each by chance."""
    b = max(least, distance + 1)
    while b < bits and comb(b, distance) * n > 2 ** (bits * (b - distance) // b):
        b += 1
    return b


def masks_on(free: list[int], blocks: int, distance: int = DISTANCE) -> list[int]:
    """Masks of every choice of blocks - distance of so many blocks of the free bits."""
    blocks = min(blocks, len(free))
    cut = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << p for p in free[a:b]) for a, b in zip(cut, cut[1:])]
    return [sum(x) for x in combinations(parts, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a - b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, after := root[root]):  # only roots are hooked, so no link is lost
            root = after
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def bucket_links(key: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints with equal keys, which stand side by side: pairs (fp, smaller fp of its tree)."""
    n = len(key)
    ends = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]]))
    size = np.diff(np.concatenate([[-1], ends]))
    left = np.repeat(ends, size) - np.arange(n)  # how many of its bucket follow each
    pivots = popcount(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8) if n and left.max() else None
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.flatnonzero(left >= 1)
    step = 1
    while len(at):
        i, j = at, at + step
        for c in range(0, len(PIVOTS), 4):
            near = (np.abs(pivots[i, c : c + 4] - pivots[j, c : c + 4]) <= distance).all(axis=1)
            i, j = i[near], j[near]
        near = popcount(fp[i] ^ fp[j]) <= distance
        found_a.append(i[near])
        found_b.append(j[near])
        step += 1
        at = at[left[at] >= step]
    distinct, name = np.unique(fp, return_inverse=True)
    root = forest(len(distinct), name[np.concatenate(found_a)], name[np.concatenate(found_b)])
    linked = np.flatnonzero(root != np.arange(len(distinct)))
    return distinct[linked], distinct[root[linked]]


def _compare(batches: Iterator[pa.RecordBatch], distance: int = DISTANCE) -> Iterator[pa.RecordBatch]:
    """Rows (mask, bits, fp) sorted by mask and bits: links (a, b), and (mask, bits) of the buckets that are too large."""

    def made(a=(), b=(), mask=(), bits=()) -> pa.RecordBatch:
        none = [None] * len(a), [None] * len(mask)
        return as_batch(
            {
                "a": pa.array([*a, *none[1]], pa.int64()),
                "b": pa.array([*b, *none[1]], pa.int64()),
                "mask": pa.array([*none[0], *mask], pa.int64()),
                "bits": pa.array([*none[0], *bits], pa.int64()),
            }
        )

    def ready(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows):
            new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            a, b = bucket_links(np.cumsum(new), rows[:, 2].copy().view(np.uint64), distance)
            if len(a):
                yield made(a.view(np.int64).tolist(), b.view(np.int64).tolist())

    held, large = np.zeros((0, 3), np.int64), None
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "bits", "fp")], axis=1)
        if large is not None:  # the rest of a bucket that is too large
            rows = rows[(rows[:, :2] != large).any(axis=1)]
            if not len(rows):
                continue
            large = None
        held = np.concatenate([held, rows])
        last = np.flatnonzero((held[:, :2] != held[-1, :2]).any(axis=1))
        tail = last[-1] + 1 if len(last) else 0  # where the last bucket, which may go on, begins
        if len(held) - tail > BUCKET:
            large = held[-1, :2].copy()
        if large is not None or tail >= ROWS // 4:
            part, held = held[:tail], held[tail:]
            yield from _sized(part, ready, made)
            if large is not None:
                yield made(mask=[int(large[0])], bits=[int(large[1])])
                held = held[:0]
    yield from _sized(held, ready, made)


def _sized(rows: np.ndarray, ready, made) -> Iterator[pa.RecordBatch]:
    """Whole buckets: links of the small ones, the keys of the others."""
    if not len(rows):
        return
    begin = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
    size = np.diff(np.concatenate([begin, [len(rows)]]))
    for i in np.flatnonzero(size > BUCKET):
        yield made(mask=[int(rows[begin[i], 0])], bits=[int(rows[begin[i], 1])])
    yield from ready(rows[np.repeat(size <= BUCKET, size)])


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for m in masks])
    return fps.select("fp", F.explode(keys).alias("k")).select("k.mask", "k.bits", "fp")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) such that distinct fingerprints (fp) within the distance of each other are connected, and only those."""
    spark = fps.sparkSession
    n = fps.count()
    keyed = _keyed(fps, masks_on(list(range(BITS)), blocks_for(n, distance=distance), distance))
    found = []
    while True:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n >> 17)
        dealt = keyed.repartition(parts, "mask", "bits").sortWithinPartitions("mask", "bits")
        out = written(dealt.mapInArrow(lambda batches: _compare(batches, distance), "a long, b long, mask long, bits long"), "pairs")
        found.append(out.where("a is not null").select("a", "b"))
        large = out.where("mask is not null").select("mask", "bits").distinct()
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]  # as many as there are choices of blocks
        if not masks:
            break
        finer = []
        for m in masks:
            free = [p for p in range(BITS) if not m >> p & 1]
            own = large.where(F.col("mask") == m)
            inside = fps.withColumn("bits", F.col("fp").bitwiseAND(F.lit(m))).join(own, "bits").select("fp")
            if len(free) <= distance:  # all of them are within the distance of each other
                star = fps.withColumn("bits", F.col("fp").bitwiseAND(F.lit(m))).join(own, "bits")
                found.append(star.join(star.groupBy("bits").agg(F.min("fp").alias("b")), "bits").select(F.col("fp").alias("a"), "b"))
            else:
                finer.append(_keyed(inside, [m % (1 << 64) | x for x in masks_on(free, max(8, distance + 1), distance)]))
        if not finer:
            break
        keyed = finer[0]
        for x in finer[1:]:
            keyed = keyed.unionByName(x)
        keyed = keyed.distinct()
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest doc_id that is reachable over links, the row's own included. Documents without words
    have fingerprint 0 and are linked like any other. Rows with a null doc_id belong to their component, but only
    lend it their links; a component without ids has a null component_id. Repeated rows stay. An empty table gives none.
    """
    own = written(fingerprints(docs, shingle), "fingerprints")
    per_fp = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(per_fp.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    tree = per_fp.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = tree.join(roots.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("least").alias("reached"))
    named = tree.join(least, "root", "left").select("fp", F.coalesce("reached", "least").alias("component_id"))
    text = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return own.join(named, "fp").select("doc_id", text, "component_id")


def without_copies(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, broadcast_rows: int = 200_000) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all columns.

    Rows without a doc_id stay: nothing tells which of them to keep. Where an id occurs more than once its rows are told apart
    by their text and other columns, and the smallest stays; rows of one id that are no near-duplicates all stay.
    """
    key, columns = "doc_id", docs.columns
    if not docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        key = "_row"
        plain = [F.col(f"`{f.name}`") for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
        row = F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text"), F.xxhash64(*plain).alias("rest"))
        docs = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), row))
    found = near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"), shingle, distance)
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "copies")
    n = gone.count()
    kept = docs.join(F.broadcast(gone) if n <= broadcast_rows else gone, key, "left_anti")
    if key == "doc_id":
        return kept
    once = kept.where("doc_id is not null").dropDuplicates([key])
    return once.unionByName(kept.where("doc_id is null")).select(*[F.col(f"`{c}`") for c in columns])
