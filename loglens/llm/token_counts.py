"""Token counts of a byte-level BPE by rank-synchronous merging of arrays.

Texts are cut into pre-tokens; those not seen yet by the task are held as one ragged array of symbols, all of
which merge their lowest-ranked pair at the same time, round by round; what survives is counted. Pre-tokens repeat, so
a task remembers counts of recent ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loglens.llm.common import as_batch, bytes_of, chunks
from loglens.llm.merges import LETTERS, NUMBERS, SPACES, Merges

LIMIT = 512
CACHE_CHUNKS = 300_000

# The pre-tokenizer of byte-level vocabularies. A chunk is a run of other signs with the space before it,
# or white space up to its last sign; only chunks of other signs are cut further.
CHUNK = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
PIECE = re.compile(f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|\\n")
WIDE_PIECE = rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\n"


class Counter(dict):
    """Numbers of tokens of chunks, remembered."""

    def __init__(self, path: str):
        import regex

        self.merges = Merges(path)
        self.wide = regex.compile(WIDE_PIECE)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.specials, key=len, reverse=True))) + ")") if self.merges.specials else None

    def pieces(self, chunk_list: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of chunks, and how many each chunk has."""
        joined = "\n".join(chunk_list) + "\n"
        cut = (PIECE if joined.isascii() or max(joined) < "Ā" else self.wide).findall(joined)
        ends = np.flatnonzero(np.fromiter((x == "\n" for x in cut), bool, len(cut)))
        return [x for x in cut if x != "\n"], np.diff(np.concatenate([[-1], ends])) - 1

    def learn(self, new: list[str]) -> None:
        narrow, wide, blank = [], [], []
        for x in new:
            (blank if x.isspace() else narrow if x.isascii() or max(x) < "Ā" else wide).append(x)
        for group in (narrow, wide):
            if not group:
                continue
            found, n = self.pieces(group)
            distinct = {x: i for i, x in enumerate(dict.fromkeys(found))}
            size = self.merges.apply([x.encode() for x in distinct])[1]
            own = size[np.fromiter(map(distinct.__getitem__, found), np.int64, len(found))]
            total = np.concatenate([[0], np.cumsum(own)])
            ends = np.cumsum(n)
            self.update(zip(group, (total[ends] - total[ends - n]).tolist(), strict=True))
        if blank:
            self.update(zip(blank, self.merges.apply([x.encode() for x in blank])[1].tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings count as the one token they are."""
        parts, extra = [], []
        for text in texts:
            own = self.special.split(text) if self.special else [text]
            parts.append(CHUNK.findall(text) if len(own) == 1 else [c for x in own[::2] for c in CHUNK.findall(x)])
            extra.append(len(own) // 2)
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        new = [x for x in dict.fromkeys(chain.from_iterable(parts)) if x not in self]
        if new:
            self.learn(new)
        return [sum(map(self.__getitem__, p)) + n for p, n in zip(parts, extra, strict=True)]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, of its whole text. Null and empty texts have no tokens.

    path: the .json file of a byte-level BPE, found there on every worker. Rows with null or repeated ids are
    rows like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            texts = bytes_of(batch.column("text"))
            for a, b in chunks(texts):
                n = np.array(counter.count([x.decode(errors="replace") for x in texts[a:b]]), np.int64)
                yield as_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "n_bytes": pa.array([len(x) for x in texts[a:b]], pa.int64()),
                        "n_tokens": pa.array(n),
                        "over_limit": pa.array(n > limit),
                    }
                )

    inner = docs.select("doc_id", "text")
    return inner.mapInArrow(run, f"doc_id {inner.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
