"""The default partitioner of the Java Kafka client: murmur2 of the key bytes.

``kafka_partition`` hashes a whole Arrow batch at once on the executors; the
loop runs over the 4-byte words of the keys, not over the rows.
``kafka_partition_native`` is the same hash as a plain Spark expression, for
jobs that must not start Python workers. ``partition_of`` hashes one literal on
the driver so that it can prune a scan.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from loglens.functions.text import col

# Fixed values of the published algorithm.
SEED = 0x9747B28C
MULTIPLIER = 0x5BD1E995
WORD_SHIFT = 24
FINAL_SHIFTS = (13, 15)
POSITIVE = 0x7FFFFFFF
MASK = 0xFFFFFFFF

# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def murmur2(keys: pa.Array) -> np.ndarray:
    """Hash of every key of a binary Arrow array (null hashes like empty)."""
    keys = keys.cast(pa.large_binary())
    _, offsets, data = keys.buffers()
    bounds = np.frombuffer(offsets, np.int64)[keys.offset : keys.offset + len(keys) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    start, size = bounds[:-1], np.diff(bounds)

    # longest keys first: the rows that still have an i-th word are a prefix
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    words = size >> 2
    m = np.uint32(MULTIPLIER)
    h = np.uint32(SEED) ^ size.astype(np.uint32)
    for i in range(int(words[0]) if len(words) else 0):
        n = int(np.searchsorted(-words, -i, side="left"))
        at = start[:n] + 4 * i
        k = raw[at].astype(np.uint32)
        for b in (1, 2, 3):
            k |= raw[at + b].astype(np.uint32) << np.uint32(8 * b)
        k *= m
        k ^= k >> np.uint32(WORD_SHIFT)
        k *= m
        h[:n] = (h[:n] * m) ^ k

    rest, tail = size & 3, start + (size & ~np.int64(3))
    for b in (2, 1, 0):
        has = rest > b
        h[has] ^= raw[tail[has] + b].astype(np.uint32) << np.uint32(8 * b)
    h[rest > 0] *= m

    h ^= h >> np.uint32(FINAL_SHIFTS[0])
    h *= m
    h ^= h >> np.uint32(FINAL_SHIFTS[1])
    out = np.empty_like(h)
    out[order] = h
    return out


def _partitions(keys: pa.Array, counts: pa.Array) -> pa.Array:
    n = np.maximum(counts.fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64), 1)
    part = (murmur2(keys) & np.uint32(POSITIVE)).astype(np.int64) % n
    missing = pc.or_(keys.is_null(), counts.is_null())
    return pa.array(part.astype(np.int32), mask=missing.to_numpy(zero_copy_only=False))


def kafka_partition(key: Column | str, partitions: Column | int) -> Column:
    """Partition of a binary (or text) key; null for a null key."""
    @F.arrow_udf("int")
    def partition(keys: pa.Array, counts: pa.Array) -> pa.Array:
        return _partitions(keys, counts)

    n = partitions if isinstance(partitions, Column) else F.lit(int(partitions))
    return partition(col(key).cast("binary"), n.cast("int"))


def partition_of(key: str | bytes, partitions: int) -> int:
    """Partition of one literal key."""
    raw = key.encode() if isinstance(key, str) else key
    return int(murmur2(pa.array([raw], pa.binary()))[0] & POSITIVE) % partitions


def kafka_partition_native(key: Column | str, partitions: Column | int) -> Column:
    """``kafka_partition`` without Python, from built-in functions only."""
    k = col(key).cast("binary")
    size = F.octet_length(k)
    # byte order reversed within every whole word; a shorter rest keeps its order
    digits = F.regexp_replace(F.hex(k), "(..)(..)(..)(..)", "$4$3$2$1")
    mask, m = F.lit(MASK), F.lit(MULTIPLIER)

    def wrap(c: Column) -> Column:
        return c.bitwiseAND(mask)

    def number(hexadecimal: Column) -> Column:
        return F.conv(hexadecimal, 16, 10).cast("bigint")

    def little_endian(at: Column, n: int) -> Column:
        """The last n bytes, from 0-based byte position ``at``, as a number."""
        return number(F.concat(*[F.substr(digits, (at + b) * 2 + 1, F.lit(2)) for b in reversed(range(n))]))

    def scramble(word: Column) -> Column:
        return wrap(word.bitwiseXOR(F.shiftrightunsigned(word, WORD_SHIFT)) * m)

    positions = F.when(size >= 4, F.sequence(F.lit(1), (size - 3) * 2, F.lit(8))).otherwise(
        F.array().cast("array<int>")
    )
    body = F.aggregate(
        F.transform(positions, lambda i: wrap(number(F.substr(digits, i, F.lit(8))) * m)),
        F.lit(SEED).bitwiseXOR(size.cast("bigint")),
        lambda h, w: wrap(h * m).bitwiseXOR(scramble(w)),
    )
    rest = size % 4
    at = size - rest
    mixed = (
        F.when(rest == 0, body)
        .when(rest == 1, wrap(body.bitwiseXOR(little_endian(at, 1)) * m))
        .when(rest == 2, wrap(body.bitwiseXOR(little_endian(at, 2)) * m))
        .otherwise(wrap(body.bitwiseXOR(little_endian(at, 3)) * m))
    )
    # the steps below use their input twice; a one-element transform names it
    def final(h: Column) -> Column:
        return wrap(h.bitwiseXOR(F.shiftrightunsigned(h, FINAL_SHIFTS[0])) * m)

    steps = F.transform(F.transform(F.array(mixed), final), lambda h: h.bitwiseXOR(F.shiftrightunsigned(h, FINAL_SHIFTS[1])))
    n = partitions if isinstance(partitions, Column) else F.lit(int(partitions))
    return (F.element_at(steps, 1).bitwiseAND(F.lit(POSITIVE)) % n).cast("int")
