"""Exact top-k search by inner product with no random access to scores.

Every component is a list of the vectors sorted by it. A query reads each list from the end that suits the component's
sign, all to the same depth. Of each vector it then knows the products read so far; an unread one is at most the
product last read from its list and at least the list's last one. So every vector has an upper and a lower bound. Who
can't reach the k-th largest lower bound is out; lists are read on until only k vectors, or ties with them, are left or
the lists end, and the scores of those are resolved.

Queries are packed in blocks in the shared folder; each task holds one block of candidates at a time and takes the
queries block by block, so neither side is ever gathered. Each block's best k per query meet in one last ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import as_batch, fresh, local_path, save_array

K, EVERY, SCALE = 5, 50, 256
#: Queries of a block, candidates of a block, and shares of the lists after which bounds are compared.
QUERIES, CANDIDATES, DEPTHS = 256, 8192, (1 / 4, 3 / 4, 7 / 8)
#: A query with so few vectors left, as a share of a block, reads no further.
FEW = 1 / 64
EXACT, LARGEST = float(1 << 53), (1 << 63) - 1


class Lists:
    """A block of candidates: components as sorted lists, and what reading them to a depth tells of each vector.

    With q+ and q- the positive and negative part of a query, both bounds are linear in (q+, q-) once the depth is
    given: a read component counts with its value instead of the last one read (upper bound) or the list's end (lower
    bound). So the bounds of all queries of a block are products of two small matrices.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.n = ids, vectors, len(ids)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        self.place = np.empty_like(order, dtype=np.int32)
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=np.int32)[:, None], axis=0)
        self.largest = np.abs(vectors).max(initial=0)
        self.read: dict[int, tuple] = {}

    def at(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Upper and lower: for each vector what its read components add, and what all lists give unread."""
        if depth not in self.read:
            down, up = self.place >= self.n - depth, self.place < depth  # read from the top, from the bottom
            first, last = self.sorted[0], self.sorted[-1]
            top, bottom = self.sorted[self.n - depth], self.sorted[depth - 1]
            self.read[depth] = (
                np.hstack([(self.vectors - top) * down, (self.vectors - bottom) * up]).T.copy(),
                np.concatenate([top, bottom]),
                np.hstack([(self.vectors - first) * down, (self.vectors - last) * up]).T.copy(),
                np.concatenate([first, last]),
            )
        return self.read[depth]

    def best(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, list[int]]]:
        """For each query ids and scores of the k best candidates of another id than its own; ties go to the smaller id."""
        if self.largest * np.abs(queries).max(initial=0) * max(queries.shape[1], 1) >= EXACT:
            return [self._whole(o, q, k) for o, q in zip(own, queries)]
        out: list = [None] * len(own)
        todo = np.arange(len(own))
        for depth in [int(self.n * share) for share in DEPTHS]:
            if not depth or not len(todo) or self.n <= 2 * k:
                continue
            q = np.hstack([np.maximum(queries[todo], 0), np.minimum(queries[todo], 0)])
            more, unread, more_low, unread_low = self.at(depth)
            lower = q @ more_low + (q @ unread_low)[:, None]
            self._without(lower, own[todo])
            least = np.partition(lower, self.n - k, axis=1)[:, self.n - k]
            left = q @ more + (q @ unread)[:, None] >= least[:, None]
            few = left.sum(axis=1) <= max(4 * k, self.n * FEW)
            for j in np.flatnonzero(few):
                out[todo[j]] = self._resolved(own[todo[j]], queries[todo[j]], np.flatnonzero(left[j]), k)
            todo = todo[~few]
        if len(todo):  # the lists are read to their ends
            scores = queries[todo] @ self.vectors.T
            self._without(scores, own[todo])
            least = np.partition(scores, max(self.n - k, 0), axis=1)[:, max(self.n - k, 0)] if self.n else scores
            for j, i in enumerate(todo):
                out[i] = self._resolved(own[i], queries[i], np.flatnonzero(scores[j] >= least[j]) if self.n else np.arange(0), k)
        return out

    def _without(self, bounds: np.ndarray, own: np.ndarray) -> None:
        q, c = np.nonzero(np.isin(own, self.ids)[:, None] & (own[:, None] == self.ids[None, :]))
        bounds[q, c] = -np.inf

    def _resolved(self, own: int, query: np.ndarray, left: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        left = left[self.ids[left] != own]
        scores = self.vectors[left] @ query
        order = np.lexsort((self.ids[left], -scores))[:k]
        return self.ids[left[order]], [int(s) for s in scores[order]]

    def _whole(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """In whole numbers of any size, for components that floats would round."""
        active = np.flatnonzero(self.ids != own)
        whole = [int(x) for x in query]
        scores = [sum(a * int(b) for a, b in zip(whole, self.vectors[i])) for i in active]
        scores = [min(max(s, -LARGEST - 1), LARGEST) for s in scores]
        order = sorted(range(len(active)), key=lambda i: (-scores[i], self.ids[active[i]]))[:k]
        return self.ids[active[order]], [scores[i] for i in order]


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, dim): components as floor(scale x); rows with a null id, vector or component, or one not finite, are out."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    large = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))  # beyond long these are whole already
    v = F.when(F.exists("embedding", lambda x: F.abs(x.cast("double")) >= 2.0**50), large).otherwise(v)
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select("vec_id", v.alias("v"), F.size("embedding").alias("dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def query_blocks(queries: DataFrame) -> list[tuple[int, str]]:
    """(dimension, path) of blocks of queries, written by tasks."""
    folder = local_path(fresh(queries.sparkSession, "queries"))
    n = queries.count()
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // QUERIES)))))

    def save(group: pa.Table) -> pa.Table:
        dim, block = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
        path = f"{folder}/{dim}-{block}"
        save_array(f"{path}-ids.npy", group.column("vec_id").to_numpy().astype(np.int64))
        save_array(f"{path}-v.npy", _matrix(group.column("v").combine_chunks(), dim))
        return pa.table({"dim": pa.array([dim], pa.int32()), "path": [path]})

    return [(r.dim, r.path) for r in dealt.groupBy("dim", "block").applyInArrow(save, "dim int, path string").collect()]


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose vec_id is divisible by every.

    All rows but the query's own are candidates; those of another dimension have no inner product with it. Fewer
    candidates give fewer rows, none give none. Equal vectors are ties. A repeated vec_id counts as the query's own; its rows
    ask and are found each for itself. Scores beyond a long are held at its ends.
    """
    rows = usable(vectors, scale)
    blocks = query_blocks(rows.where(F.col("vec_id") % every == 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def searched(dim: int) -> Iterator[pa.RecordBatch]:
            parts = held.pop(dim)
            lists = Lists(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            for d, path in blocks:
                if d != dim:
                    continue
                asked, out = np.load(f"{path}-ids.npy"), []
                for number, (ids, scores) in enumerate(lists.best(asked, np.load(f"{path}-v.npy"), k)):
                    out += [(f"{path}/{number}", int(asked[number]), int(i), s) for i, s in zip(ids, scores)]
                yield as_batch(
                    {
                        "asked": pa.array([o[0].rpartition("/queries-")[2] for o in out], pa.string()),
                        "query_id": pa.array([o[1] for o in out], pa.int64()),
                        "vec_id": pa.array([o[2] for o in out], pa.int64()),
                        "score": pa.array([o[3] for o in out], pa.int64()),
                    }
                )

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                for a in range(0, own.num_rows, CANDIDATES):
                    part = own.slice(a, CANDIDATES)
                    held.setdefault(dim, []).append((part.column("vec_id").to_numpy().astype(np.int64), _matrix(part.column("v"), dim)))
                    if sum(len(p[0]) for p in held[dim]) >= CANDIDATES:
                        yield from searched(dim)
        for dim in list(held):
            yield from searched(dim)

    found = rows.mapInArrow(run, "asked string, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
