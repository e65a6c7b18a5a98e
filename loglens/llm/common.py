"""What the operators share: folders, columns, words, hashes and chunks of rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at once. A longer text is handled alone.
CHUNK_BYTES = 4 << 20
#: Entries of a task's word cache. A full cache is emptied, so it bounds memory and changes no result.
CACHE_WORDS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one of a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder: computed once, and still there when an executor is lost."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; -1 for a null key, which so is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(-1))


def local_path(url: str) -> str:
    """The path of a shared folder that workers can map into memory."""
    if url.startswith("file:"):
        return "/" + url.removeprefix("file:").lstrip("/")
    if "://" in url:
        raise ValueError(f"{url}: a mounted folder is needed here, so that workers can map its files into memory")
    return url


def save_array(path: str, values: np.ndarray) -> None:
    """Whole or not at all: a repeated task replaces the file by an equal one."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, values)
    os.replace(part, path)


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with at most limit bytes of text; at least one row each."""
    begin, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(x)
    if begin < len(texts):
        yield begin, len(texts)


class WordHash(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def hashed(words: Iterable[bytes], cache: dict, n: int = -1) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_batch(fields: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(fields.values()), list(fields))


#: ASCII white space ends a word, ASCII capitals are lowered: bytes.lower() and bytes.split() do exactly this.
def spaced_words(text: bytes) -> list[bytes]:
    return text.lower().split()


#: Letters of the word class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lowering A-Z; all other bytes become spaces.
WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()
