"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by the workers that score.

Words are known by their 64-bit hashes. A word's id is its rank among the sorted hashes; a longer n-gram's key holds the
id of the n-gram without its last word and the id of that word, and its own id is its rank among the sorted keys. So
every order is a sorted array of 64-bit keys, an n-gram is found by one binary search per order, and n-grams of
equal beginning lie side by side.

The array of an order is cut into parts of keys; tasks combine keys before the shuffle and send each part one
packed row, and one task per part merges them, computes what it can and writes it to the shared folder. Bounds of parts
follow the counts of the order below and cut through frequent beginnings as well, so no part grows with a hot
word. Nothing but a few numbers per part reaches the driver.

Each text is: begin, its words, end. The begin is context only. Order n - 1 and below use continuation counts, and raw
ones for n-grams at a text's begin.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm.common import CACHE_WORDS, as_batch, bytes_of, chunks, fresh, local_path, save_array, spaced_words

#: Words hold no space, so these are no words.
BEGIN, END = b" begin", b" end"
#: Keys that a task combines at once, and tokens behind a part of an order.
FLUSH, PART_TOKENS, STRETCH = 1 << 21, 1 << 22, 2 << 20
#: Files of an order that a process keeps mapped, their names, and bytes of their tables.
OPEN, COUNTED, BELOW, HEAD = 4096, "counted", "below", 1024
LARGEST, LOW = 1 << 32, np.uint64(0xFFFFFFFF)
SCORED = "n_tokens long, n_known long, base_score double, score double"


def small_counts(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Small counts as bytes, 255 standing for those that are listed apart."""
    large = np.flatnonzero(values >= 255)
    return {name: np.minimum(values, 255).astype(np.uint8), f"{name}-at": large, f"{name}-large": values[large].astype(np.uint64)}


def save_together(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one behind the other in one file, whole or not at all; a table of names, kinds, places and sizes comes first."""
    table, at = [], HEAD
    for name, x in arrays.items():
        table.append([name, x.dtype.str, at, len(x)])
        at += -(-x.nbytes // 8) * 8
    out = np.zeros(at, np.uint8)
    head = json.dumps(table).encode()
    out[: len(head)] = np.frombuffer(head, np.uint8)
    for (_, _, start, _), x in zip(table, arrays.values()):
        out[start : start + x.nbytes] = np.ascontiguousarray(x).view(np.uint8)
    save_array(path, out)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of such a file, mapped into memory."""
    raw = np.load(path, mmap_mode="r")
    table = json.loads(bytes(raw[:HEAD]).rstrip(b"\0"))
    return {name: raw[at : at + n * np.dtype(kind).itemsize].view(kind) for name, kind, at, n in table}


@dataclass
class Order:
    """The n-grams of one length: a folder with two files for each part, parts' first keys and sizes.

    One file has the keys and raw counts, the other one what the order above made of it.
    """

    folder: str
    bounds: np.ndarray
    sizes: np.ndarray

    def __post_init__(self):
        self.base = np.concatenate([[0], np.cumsum(self.sizes)])
        if self.base[-1] >= LARGEST:
            raise ValueError("an order of the model has 2^32 n-grams or more, which ids don't reach")
        self._open: dict = {}

    def __getstate__(self):
        return {"folder": self.folder, "bounds": self.bounds, "sizes": self.sizes}

    def __setstate__(self, state):
        self.__init__(**state)

    def path(self, file: str, part: int) -> str:
        return f"{self.folder}/{part}/{file}.npy"

    def array(self, name: str, part: int) -> np.ndarray:
        """A mapped array. At most OPEN files stay open; those that others still use are closed by their last user."""
        file = COUNTED if name.split("-")[0] in ("keys", "raw") else BELOW
        found = self._open.get((file, part))
        if found is None:
            if len(self._open) >= OPEN:
                self._open.clear()
            self._open[file, part] = found = mapped(self.path(file, part))
        return found[name]

    def part_counts(self, name: str, part: int, at: np.ndarray | None = None) -> np.ndarray:
        out = (self.array(name, part)[:] if at is None else self.array(name, part)[at]).astype(np.int64)
        full = np.flatnonzero(out == 255)
        if len(full):
            listed = np.searchsorted(self.array(f"{name}-at", part), full if at is None else at[full])
            out[full] = self.array(f"{name}-large", part)[listed]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of keys; -1 for those that aren't there."""
        order = np.argsort(keys)
        asked = keys[order]
        found = np.full(len(keys), -1, np.int64)
        cut = np.searchsorted(asked, self.bounds[1:])
        for p, (a, b) in enumerate(zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(asked)]]))):
            if a < b and self.sizes[p]:
                own = self.array("keys", p)
                at = np.minimum(np.searchsorted(own, asked[a:b]), len(own) - 1)
                found[a:b] = np.where(own[at] == asked[a:b], at + self.base[p], -1)
        out = np.empty(len(keys), np.int64)
        out[order] = found
        return out

    def facts(self, ids: np.ndarray, *names: str) -> list[np.ndarray]:
        """Values of ids by name; of the id -1: 0, and 1 for backoff weights. Ids are dealt to parts once for all names."""
        real = [n == "backoff" for n in names]
        out = [np.full(len(ids), float(x)) if x else np.zeros(len(ids), np.uint64 if n == "keys" else np.int64) for n, x in zip(names, real)]
        part = np.searchsorted(self.base, ids, side="right")  # of -1: 0
        order = np.argsort(part.astype(np.uint32), kind="stable")
        cut = np.searchsorted(part[order], np.arange(len(self.base) + 1))
        for p in np.flatnonzero(cut[1:-1] < cut[2:]):
            own = order[cut[p + 1] : cut[p + 2]]
            at = ids[own] - self.base[p]
            for name, values in zip(names, out):
                values[own] = self.array(name, p)[at] if name in ("keys", "backoff") else self.part_counts(name, p, at)
        return out

    def keys_of(self, ids: np.ndarray) -> np.ndarray:
        return self.facts(ids.astype(np.int64), "keys")[0]

    def counts(self, name: str, ids: np.ndarray) -> np.ndarray:
        return self.facts(ids, name)[0]


class WordIds(dict):
    """Ids of words, remembered; -1 for unknown ones. Words that are new get numbers below that until they are looked up."""

    def __init__(self, words: Order):
        self.words, self.new = words, []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = out = -1 - len(self.new)
        return out

    def of(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.new:
            found = self.words.find(hashes(self.new))
            self.update(zip(self.new, found.tolist(), strict=True))
            at = np.flatnonzero(out < -1)
            out[at] = found[-2 - out[at]]
            self.new = []
        return out


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def tokens_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Begin, words and end of each text, one after another, and where each begins and the last ends."""
    out, bound = [], [0]
    for x in texts:
        out.append(BEGIN)
        out += spaced_words(x)
        out.append(END)
        bound.append(len(out))
    return out, np.array(bound)


def joined(prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
    return prefix.astype(np.uint64) << np.uint64(32) | last.astype(np.uint64)


def without_first(orders: list[Order], keys: np.ndarray) -> np.ndarray:
    """Ids in the last of the orders of the n-grams with these keys of the order above, each without its first word.

    Found anew by way of the beginnings, so nothing is stored for it.
    """
    if len(orders) == 1:
        return (keys & LOW).astype(np.int64)
    shorter = without_first(orders[:-1], orders[-1].keys_of(keys >> np.uint64(32)))
    return orders[-1].find(joined(shorter, keys & LOW))


def grams(orders: list[Order], words: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
    """For each order, the id of the n-gram that ends at each token; -1 where it is unknown or the text too short."""
    ids = [words]
    place = np.arange(len(words)) - np.repeat(bound[:-1], np.diff(bound))
    for n, order in enumerate(orders[1:], 2):
        prefix = np.concatenate([[-1], ids[-1][:-1]])
        some = np.flatnonzero((prefix >= 0) & (words >= 0) & (place >= n - 1))
        out = np.full(len(words), -1, np.int64)
        out[some] = order.find(joined(prefix[some], words[some]))
        ids.append(out)
    return ids


def _keys(orders: list[Order]):
    """Per task: keys of the next order with their counts, packed by part of it."""

    def of(texts: list[bytes], cache: WordIds | None) -> np.ndarray:
        tokens, bound = tokens_of(texts)
        if not orders:
            return hashes(tokens)
        words = cache.of(tokens)
        ids = grams(orders, words, bound)[-1]
        place = np.arange(len(words)) - np.repeat(bound[:-1], np.diff(bound))
        at = np.flatnonzero(place >= len(orders))
        return joined(ids[at - 1], words[at])

    return of


def squeezed(values: np.ndarray, kind: str) -> bytes:
    """Numbers as compressed planes of their first bytes, their second bytes and so on."""
    planes = values.astype(kind).view(np.uint8).reshape(len(values), -1).T if len(values) else values
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True) if len(values) else b""


def expanded(data: bytes, kind: str, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def _packed(part: int, keys: np.ndarray, counts: np.ndarray) -> tuple[int, int, bytes, bytes, bytes]:
    """Sorted keys as steps of their upper halves and lower halves, which compress well."""
    step = np.diff((keys >> np.uint64(32)).astype(np.int64), prepend=0)
    return part, len(keys), squeezed(step, "<u4"), squeezed(keys & LOW, "<u4"), squeezed(counts, "<u4")


def _unpacked(n: int, step: bytes, low: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    high = np.cumsum(expanded(step, "<u4", n), dtype=np.uint64)
    return high << np.uint64(32) | expanded(low, "<u4", n), expanded(counts, "<u4", n).astype(np.int64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate([np.zeros(0, np.uint64), *keys])
    c = np.concatenate([np.zeros(0, np.int64), *counts])
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


PACKED = "part int, n int, step binary, low binary, counts binary"
META = "part int, n long, mass long, n1 long, n2 long, n3 long, n4 long, cuts array<long>"


def _meta(part: int, n: int, values: np.ndarray, cuts: list[int]) -> pa.Table:
    kinds = np.bincount(np.minimum(values, 5).astype(np.int64), minlength=6)
    row = {"part": [part], "n": [n], "mass": [int(values.sum())]} | {f"n{i}": [int(kinds[i])] for i in range(1, 5)} | {"cuts": [cuts]}
    types = {"part": pa.int32(), "cuts": pa.list_(pa.int64())}
    return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in row.items()})


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is collected in here leaves no shuffle files behind, which would stay until the driver's next full collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def count_order(docs: DataFrame, orders: list[Order], bounds: np.ndarray, per_part: float) -> tuple[Order, list]:
    """Counts the next order and writes its keys and counts. Also gives the parts' numbers, with cuts for the order above."""
    folder, keys_of = fresh(docs.sparkSession, f"grams-{len(orders) + 1}"), _keys(orders)
    path = local_path(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordIds(orders[0]) if orders else None
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            at = np.concatenate([np.searchsorted(keys, bounds), [len(keys)]])
            rows = [_packed(p, keys[a:b], counts[a:b]) for p, (a, b) in enumerate(zip(at, at[1:])) if a < b]
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return as_batch({k: pa.array([r[i] for r in rows], types[i]) for i, k in enumerate(("part", "n", "step", "low", "counts"))})

        for batch in batches:
            texts = bytes_of(batch.column("text"))
            for a, b in chunks(texts, STRETCH):
                held.append(keys_of(texts[a:b], cache))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        own = [_unpacked(*(group.column(c)[i].as_py() for c in ("n", "step", "low", "counts"))) for i in range(group.num_rows)]
        keys, counts = _merged([k for k, _ in own], [c for _, c in own])
        save_together(f"{path}/{part}/{COUNTED}.npy", {"keys": keys} | small_counts("raw", counts))
        # Cuts of the order above: where the counts so far pass equal shares, as a place in the array in 65536ths.
        so_far = np.cumsum(counts)
        n = int(4 * so_far[-1] / per_part) + 1
        share = np.arange(1, n) * (so_far[-1] / n)
        at = np.searchsorted(so_far, share)
        into = (share - (so_far[at] - counts[at])) / counts[at]
        return _meta(part, len(keys), counts, (at * 65536 + (into * 65535).astype(np.int64)).tolist())

    with shuffles_dropped(docs.sparkSession):
        meta = docs.select("text").mapInArrow(run, PACKED).groupBy("part").applyInArrow(merge, META).collect()
    by_part = {r.part: r for r in meta}
    sizes = np.array([by_part[p].n if p in by_part else 0 for p in range(len(bounds))], np.int64)
    return Order(path, bounds, sizes), [by_part.get(p) for p in range(len(bounds))]


def cuts_above(order: Order, meta: list, n_words: int, parts: int) -> np.ndarray:
    """First keys of about so many parts of the order above. A beginning that fills several is cut by its last word."""
    keys, mass = [], []
    for p, r in enumerate(meta):
        if r is not None:
            own = [int(order.base[p]) << 32] + [(int(order.base[p]) + c // 65536) << 32 | c % 65536 * n_words // 65536 for c in r.cuts]
            keys += own
            mass += [r.mass / len(own)] * len(own)
    if not keys:
        return np.zeros(1, np.uint64)
    before = np.cumsum(mass) - mass
    part = (before * parts / sum(mass)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return np.array([0, *sorted({keys[i] for i in first} - {0})], np.uint64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Of counts 0, 1, 2 and more, from the numbers of n-grams with counts 1 to 4; halves where these don't tell."""
    if not (n1 and n2):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0] + [float(np.clip(x, 0.01, i - 0.01)) for i, x in enumerate(d[1:], 1)])


#: What an order sends to the one below: name, kind of number, and what says how many there are.
SENT = (("ids", "<u4", "n_ids"), ("n", "<u4", "n_ids"), ("ctx", "<u4", "n_ctx"), ("total", "<i8", "n_ctx"), ("spare", "<f4", "n_ctx"))


def _below(orders: list[Order], k: int, name: str, d: np.ndarray, spark) -> list:
    """From order k (counts: name; discounts: d) writes of order k - 1: continuation counts, totals and backoff weights."""
    order, below = orders[k - 1], orders[k - 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("part").to_pylist():
                keys, c = order.array("keys", p)[:], order.part_counts(name, p)
                prefix = (keys >> np.uint64(32)).astype(np.int64)
                ids, n = np.unique(without_first(orders[: k - 1], keys), return_counts=True)
                first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
                total = np.add.reduceat(c, first)
                spare = np.add.reduceat(d[np.minimum(c, 3)], first)
                ctx = prefix[first]
                at_n, at_c = np.searchsorted(ids, below.base), np.searchsorted(ctx, below.base)
                rows = []
                for q in range(len(below.sizes)):
                    a, b, e, f = at_n[q], at_n[q + 1], at_c[q], at_c[q + 1]
                    if a < b or e < f:
                        own = np.diff(ids[a:b], prepend=0), n[a:b], np.diff(ctx[e:f], prepend=0), total[e:f], spare[e:f]
                        rows.append((q, b - a, f - e, *(squeezed(x, kind) for x, (_, kind, _) in zip(own, SENT))))
                yield as_batch(
                    {x: pa.array([r[i] for r in rows], pa.int32()) for i, x in enumerate(("part", "n_ids", "n_ctx"))}
                    | {x: pa.array([r[i] for r in rows], pa.binary()) for i, (x, _, _) in enumerate(SENT, 3)}
                )

    def merge(group: pa.Table) -> pa.Table:
        q = group.column("part")[0].as_py()
        size, base = int(below.sizes[q]), int(below.base[q])
        found, total, spare = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
        for i in range(group.num_rows):
            ids, n, ctx, t, s = (expanded(group.column(c)[i].as_py(), kind, group.column(m)[i].as_py()) for c, kind, m in SENT)
            found[np.cumsum(ids, dtype=np.int64) - base] += n
            at = np.cumsum(ctx, dtype=np.int64) - base
            total[at] += t
            spare[at] += s
        if k > 2:  # n-grams that nothing precedes stand at a text's begin
            found = np.where(found == 0, below.part_counts("raw", q), found)
        backoff = (spare / np.maximum(total, 1)).astype(np.float32)
        save_together(below.path(BELOW, q), small_counts("adjusted", found) | small_counts("total", total) | {"backoff": backoff})
        return _meta(q, size, found, [])

    parts = [(p,) for p in range(len(order.sizes)) if order.sizes[p]]
    dealt = spark.createDataFrame(parts, "part int").repartition(len(parts))
    with shuffles_dropped(spark):
        packed = dealt.mapInArrow(run, "part int, n_ids int, n_ctx int, " + ", ".join(f"{c} binary" for c, _, _ in SENT))
        return packed.groupBy("part").applyInArrow(merge, META).collect()


@dataclass
class Model:
    """A fitted model: its orders, the discounts of each, tokens (ends included) and distinct tokens it was learnt from."""

    orders: list[Order]
    discounts: list[np.ndarray]
    tokens: int
    words: int
    total: int  # of continuation counts
    spare: float  # what the discounts of single words leave

    def log10(self, words: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """log10 of each token's probability after those before it; of begins, 0."""
        ids = grams(self.orders, words, bound)
        top = len(self.orders)
        d = self.discounts[0]
        c, *behind = self.orders[0].facts(words, *(("raw",) if top == 1 else ("adjusted", "total", "backoff")))
        p = (c - d[np.minimum(c, 3)] + self.spare / (self.words + 1)) / max(self.total, 1)
        if not self.total:
            p = np.full(len(words), 1.0 / (self.words + 1))
        for k in range(2, top + 1):
            # What follows an n-gram is found at the token behind it; before the first one nothing is known.
            total, weight = (np.concatenate([[x], y[:-1]]) for x, y in zip((0, 1.0), behind))
            d = self.discounts[k - 1]
            c, *behind = self.orders[k - 1].facts(ids[k - 1], *(("raw",) if k == top else ("adjusted", "total", "backoff")))
            seen = total > 0
            more = np.where(seen, (c - d[np.minimum(c, 3)]) / np.where(seen, total, 1), 0)
            p = more + np.where(seen, weight, 1.0) * p
        out = np.log10(p)
        out[bound[:-1]] = 0
        return out


def learn(docs: DataFrame, order: int = 3) -> Model:
    """Fits all texts of docs; null ones are empty. Without rows, every token of a text is equally unlikely."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_chars = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(least, n_chars // (6 * PART_TOKENS))
    even = np.array([(i << 64) // parts for i in range(parts)], np.uint64)
    words, meta = count_order(docs, [], even, n_chars / 6 / parts + 1)
    n_docs = int(words.counts("raw", words.find(hashes([BEGIN])))[0])
    tokens = sum(r.mass for r in meta if r is not None) - n_docs
    n_words = int(words.base[-1]) - (n_docs > 0)
    orders, metas = [words], [meta]
    for _ in range(2, order + 1 if n_docs else 2):
        bounds = cuts_above(orders[-1], metas[-1], n_words + 1, parts)
        next_order, next_meta = count_order(docs, orders, bounds, tokens / parts + 1)
        orders.append(next_order)
        metas.append(next_meta)

    def sums(rows: list) -> list[int]:
        return [sum(r[f"n{i}"] for r in rows if r is not None) for i in range(1, 5)]

    ds = [discounts(*sums(metas[-1]))]
    kinds = sums(metas[-1])
    for k in range(len(orders), 1, -1):
        rows = _below(orders, k, "raw" if k == len(orders) else "adjusted", ds[0], spark)
        kinds, mass, n = sums(rows), sum(r.mass for r in rows), sum(r.n for r in rows)
        ds.insert(0, discounts(*kinds))
    if len(orders) == 1:
        mass, n = tokens, n_words
    d = ds[0]
    spare = d[1] * kinds[0] + d[2] * kinds[1] + d[3] * max(n - (n_docs > 0) * (len(orders) > 1) - kinds[0] - kinds[1], 0)
    return Model(orders, ds, tokens, n_words, mass, float(spare))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row, of its whole text.

    score is the model's log10 probability of the text's tokens, its end included; base_score that of single words with
    half a count added. n_known tokens occur in what was learnt. A null or empty text is its end alone. Repeated rows
    get equal results, null ids stay null; a long text is scored alone, as a whole. Other columns are ignored, also those
    named like results.
    """
    n, v = model.tokens, model.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordIds(model.orders[0])
        for batch in batches:
            texts = bytes_of(batch.column("text"))
            for a, b in chunks(texts, STRETCH):
                tokens, bound = tokens_of(texts[a:b])
                words = cache.of(tokens)
                c = model.orders[0].counts("raw", words)
                base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
                known = (c > 0).astype(np.int64)
                base[bound[:-1]], known[bound[:-1]] = 0, 0
                yield as_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "n_tokens": pa.array(np.diff(bound) - 1),
                        "n_known": pa.array(np.add.reduceat(known, bound[:-1])),
                        "base_score": pa.array(np.add.reduceat(base, bound[:-1])),
                        "score": pa.array(np.add.reduceat(model.log10(words, bound), bound[:-1])),
                    }
                )

    inner = docs.select("doc_id", "text")
    return inner.mapInArrow(run, f"doc_id {inner.schema['doc_id'].dataType.simpleString()}, {SCORED}")
