"""Byte-pair merges applied to many sequences at once, on ragged numpy arrays."""

from __future__ import annotations

import json
import unicodedata

import numpy as np

NEVER = np.int32(0x7FFFFFFF)

#: Letters and numbers of Latin-1 and Unicode's white space, for patterns of the re module (whose \s has more).
LETTERS = "".join(chr(i) for i in range(256) if unicodedata.category(chr(i))[0] == "L")
NUMBERS = "".join(chr(i) for i in range(256) if unicodedata.category(chr(i))[0] == "N")
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: itself if printable, else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Merges:
    """The merge rules of a byte-level tokenizer file, as tables.

    A pair of symbols is looked up in an open hash table; its rank is the rule's place, its result the merged symbol.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        signs = byte_signs()
        self.specials = {x["content"]: x["id"] for x in whole["added_tokens"] if x["special"]}
        self.first = np.array([vocab[s] for s in signs], np.int32)
        self.last = np.array([vocab[s + suffix] for s in signs], np.int32)
        rules = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        left = np.array([vocab[a] for a, _ in rules], np.int64)
        right = np.array([vocab[b] for _, b in rules], np.int64)
        self.result = np.array([vocab[a + b] for a, b in rules], np.int32)
        self.bits = int(4 * len(rules)).bit_length()
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NEVER, np.int32)
        key, rank = left << 32 | right, np.arange(len(rules), dtype=np.int32)
        step = 0
        while len(key):  # those that find their place taken go on to the next one
            at = (self._slot(key) + step) & ((1 << self.bits) - 1)
            free = np.flatnonzero(self.key[at] < 0)
            self.key[at[free]] = key[free]
            won = self.key[at] == key
            self.rank[at[won]] = rank[won]
            key, rank = key[~won], rank[~won]
            step += 1
        self.steps = step

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        out = np.full(len(key), NEVER, np.int32)
        todo = np.arange(len(key))
        for _ in range(self.steps):
            found = self.key[at]
            same = found == key[todo]
            out[todo[same]] = self.rank[at[same]]
            go = ~same & (found >= 0)
            todo, at = todo[go], (at[go] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return out

    def apply(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all pieces, one after another, and how many each piece has; empty pieces have none.

        In each round every sequence merges all places of its pair of lowest rank, overlapping ones from the left.
        """
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sym = self.first[raw]
        ends = np.cumsum(size)
        some = size > 0
        sym[ends[some] - 1] = self.last[raw[ends[some] - 1]]
        seq = np.repeat(np.arange(len(pieces)), size)
        done_sym, done_seq = [], []
        rank = np.full(len(sym), NEVER, np.int32)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            low = np.minimum.reduceat(rank, start)
            n = np.diff(np.concatenate([start, [len(sym)]]))
            over = np.repeat(low == NEVER, n)
            if over.any():
                done_sym.append(sym[over])
                done_seq.append(seq[over])
                sym, seq, rank = sym[~over], seq[~over], rank[~over]
                n, low = n[low != NEVER], low[low != NEVER]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, n))
            run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            if not run.all():  # of hits side by side every second one
                begin = np.flatnonzero(run)
                hit = hit[(np.arange(len(hit)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(hit)]])))) % 2 == 0]
            sym[hit] = self.result[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            at = hit - np.arange(len(hit))  # where the merged symbols are now
            again = np.concatenate([at, at[at > 0] - 1])
            again = again[again < len(sym)]
            rank[again] = NEVER
            again = again[again + 1 < len(sym)]
            again = again[seq[again] == seq[again + 1]]
            rank[again] = self.ranks(sym[again], sym[again + 1])
        sym, seq = np.concatenate([np.zeros(0, np.int32), *done_sym]), np.concatenate([np.zeros(0, np.int64), *done_seq])
        return sym[np.argsort(seq, kind="stable")], np.bincount(seq, minlength=len(pieces))
