"""Best-fit packing of tokenized documents, planned on the histogram of lengths.

1. Each document is cut into pieces of at most capacity tokens; only longer documents give several.
2. The plan needs only how many pieces have each length: best-fit decreasing over counts. Sequences with the same
   remaining room and filling are one group, so the plan's size depends on the capacity, not on the documents.
3. The planned slots of a length are numbered 0, 1, 2, ... Pieces of that length are numbered alike and take the slot of
   their number. Numbering counts per (length, bucket of a hash) first, so that no task holds all pieces of a length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import as_batch, bytes_of, chunks, written
from loglens.llm.merges import LETTERS, NUMBERS, SPACES, Merges

CAPACITY, END_ID = 4096, 1
CACHE_CHUNKS = 300_000
#: Pieces of one length that are numbered together, on average at most.
NUMBERED = 512

#: Called once per task, so that it can load what it needs there; gives what turns texts into the ids of their tokens.
Encoder = Callable[[], Callable[[list[bytes]], list[bytes]]]


# The pre-tokenizer of word_bpe files, for the signs of Latin-1.
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}\\n]+|\\n")


class WordEncoder(dict):
    """Little-endian 32-bit ids of texts, by a tokenizer that lowers letters, drops white space and joins nothing over it.

    Such a tokenizer's ids of a text are those of its chunks between white space, which repeat and are remembered.
    Chunks of Latin-1 are cut and merged here, many at once; the library encodes the others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(path), Merges(path)

    def learn(self, new: list[bytes]) -> None:
        texts = [x.decode(errors="replace") for x in new]
        plain = [(x.isascii() or max(x) < "\u0100") and "<|" not in x for x in texts]
        keys, own = [x for x, p in zip(new, plain) if p], [x.lower() for x, p in zip(texts, plain) if p]
        if own:
            cut = PIECE.findall("\n".join(own) + "\n")
            ends = np.flatnonzero(np.fromiter((x == "\n" for x in cut), bool, len(cut)))
            found = [x for x in cut if x != "\n"]
            n = np.cumsum(np.diff(np.concatenate([[-1], ends])) - 1).tolist()
            distinct = {x: i for i, x in enumerate(dict.fromkeys(found))}
            ids, size = self.merges.apply([x.encode() for x in distinct])
            raw, end = ids.astype("<u4").tobytes(), (4 * np.cumsum(size)).tolist()
            parts = [raw[a:b] for a, b in zip([0, *end], end)]
            each = [parts[distinct[x]] for x in found]
            self.update((k, b"".join(each[a:b])) for k, a, b in zip(keys, [0, *n], n))
        for k, x, p in zip(new, texts, plain):
            if not p:
                self[k] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        parts = [x.split() for x in texts]
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        new = [x for x in dict.fromkeys(chain.from_iterable(parts)) if x not in self]
        if new:
            self.learn(new)
        return [b"".join(map(self.__getitem__, p)) for p in parts]


def word_encoder(path: str) -> Encoder:
    """For tokenizers' .json files whose normalizer makes white space equal and whose pre-tokenizer removes it."""
    return lambda: WordEncoder(path)


def pieces(docs: DataFrame, encoder: Encoder, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row; an empty text is its end token alone."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            texts = bytes_of(batch.column("text"))
            for a, b in chunks(texts):
                row, piece, length, crc = [], [], [], []
                for i, ids in enumerate(encode(texts[a:b]), a):
                    ids += end
                    for k in range(0, len(ids), 4 * capacity):
                        own = ids[k : k + 4 * capacity]
                        row.append(i)
                        piece.append(k // (4 * capacity))
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                number = np.array(piece, np.int64)
                yield as_batch(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())),
                        "piece": pa.array(number.astype(np.int32)),
                        "start": pa.array(number * capacity),
                        "length": pa.array(length, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    inner = docs.select("doc_id", "text")
    return inner.mapInArrow(run, f"doc_id {inner.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first number, how many, first sequence, offset).

    The pieces numbered first ... first + many - 1 of a length go to as many consecutive sequences, at the offset.
    """
    room: list[int] = []  # ascending distinct rooms of open sequences
    groups: dict[int, list[tuple[int, int]]] = {}  # room: runs (first sequence, how many)
    out, used = [], 0

    def put(left: int, first: int, many: int) -> None:
        if left:
            if left not in groups:
                groups[left] = []
                insort(room, left)
            runs = groups[left]
            if runs and runs[-1][0] + runs[-1][1] == first:
                runs[-1] = (runs[-1][0], runs[-1][1] + many)
            else:
                runs.append((first, many))

    for length in sorted(counts, reverse=True):
        number, todo = 0, counts[length]
        while todo:
            at = bisect_left(room, length)
            if at == len(room):  # nothing fits: open sequences, each filled with as many of this length as it takes
                per, size = capacity // length, todo
                whole = size // per
                for first, many, k in ((used, whole, per), (used + whole, 1, size - whole * per)):
                    if many and k:
                        for j in range(k):
                            out.append((length, number, many, first, j * length))
                            number += many
                        put(capacity - k * length, first, many)
                        used += many
                todo = 0
                continue
            left = room[at]
            first, many = groups[left][-1]
            now = min(many, todo)
            if now == many:
                groups[left].pop()
                if not groups[left]:
                    del groups[left]
                    room.pop(at)
            else:
                groups[left][-1] = (first, many - now)
            begin = first + many - now
            out.append((length, number, now, begin, capacity - left))
            put(left - length, begin, now)
            number, todo = number + now, todo - now
    return out


def numbered(found: DataFrame, counts: dict[int, int]) -> DataFrame:
    """found with number: 0, 1, 2, ... within each length, in the order of hash bucket, doc_id, piece and checksum.

    A length has buckets in proportion to its pieces, so a length that most pieces have is numbered by many tasks.
    """
    spark = found.sparkSession
    buckets = spark.createDataFrame([(k, -(-n // NUMBERED)) for k, n in counts.items()], "length long, buckets long")
    spread = found.join(F.broadcast(buckets), "length")  # a row per length: at most the capacity
    spread = spread.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "buckets")).drop("buckets")
    sizes = spread.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = spread.withColumn("own", F.row_number().over(own) - 1)
    return ranked.join(sizes, ["length", "bucket"]).withColumn("number", F.col("own") + F.col("before")).drop("own", "before", "bucket")


def pack(docs: DataFrame, encoder: Encoder, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """pieces with sequence_id and offset. Offsets of a sequence's pieces are gapless from 0.

    Every row of docs is packed, equal rows and null ids too. Null and empty texts are one piece of one token. An empty
    table gives no rows.
    """
    found = written(pieces(docs, encoder, capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most capacity of them
    by_length: dict[int, list] = {k: [] for k in counts}
    for length, *rest in plan(counts, capacity):
        by_length[length].append(rest)
    slots = {k: np.array(sorted(v), np.int64) for k, v in by_length.items()}
    shared = docs.sparkSession.sparkContext.broadcast(slots)  # its size depends on the capacity only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                runs = shared.value[int(k)]
                r = np.searchsorted(runs[:, 0], number[at], side="right") - 1
                sequence[at] = runs[r, 2] + number[at] - runs[r, 0]
                offset[at] = runs[r, 3]
            kept = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield as_batch(kept | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    kind = found.schema["doc_id"].dataType.simpleString()
    return numbered(found, counts).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
