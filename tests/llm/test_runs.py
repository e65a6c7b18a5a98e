"""Periodic runs against brute force over all periods."""

import hashlib
import random
import zlib

import pytest

from loglens.llm import runs
from loglens.llm.queries import REGISTRY, planted_run

DOCS = "doc_id long, text string"


def brute(words):
    """All stretches of each lag that can't be extended, with that lag as smallest period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e < n - q and words[e] == words[e + q]:
                e += 1
            part = words[i : e + q]
            if len(part) >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_text(rng):
    out = []
    while len(out) < rng.randint(0, 160):
        unit = rng.choices("ab" if rng.random() < 0.5 else "abcd", k=rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 24, 31]))
        length = int(len(unit) * rng.choice([1, 2, 3.5, 4, 4.5, 6, 9]))
        out += (unit * 10)[:length] + rng.choices("abcdefgh", k=rng.randint(0, 4))
    return [w.encode() for w in out]


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [periodic_text(rng) for _ in range(60)] + [[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a"] * 3000, [b"a", b"b", b"c"] * 4]
    assert runs.runs_of(texts) == [brute(t) for t in texts]


def test_run_of_a_run():
    """Runs within the period of a longer run, and long periods."""
    unit = [b"x"] * 7 + [b"y", b"z"] * 5 + [str(i).encode() for i in range(300)]
    text = unit * 5
    got = runs.runs_of([text])[0]
    assert got == brute(text) and (0, len(text), len(unit)) in got


def test_words_of_different_documents_are_no_run():
    assert runs.runs_of([[b"a"] * 3] * 9) == [[]] * 9


def test_best_compares_exactly():
    assert runs.best([(0, 13, 3), (20, 26, 6), (60, 9, 2), (90, 18, 4)]) == (60, 9, 2)
    assert runs.best([]) is None


def result(spark, rows, schema=DOCS, prepare=None):
    return runs.periodic_runs(spark.createDataFrame(rows, schema), prepare)


def test_edges_and_clashing_columns(spark):
    long = " ".join(["w%d" % (i % 1000) for i in range(200_000)])
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a " * 6), (5, "A a A a A a A a"), (5, "A a A a A a A a"), (6, "x" * 300_000), (7, long)]
    got = result(spark, [(*r, "y", "y") for r in rows], DOCS + ", runs string, collapsed string").collect()
    assert [(r.doc_id, r.n_words, len(r.runs), r.collapsed[:20]) for r in got] == [
        (1, 0, 0, ""),
        (2, 0, 0, ""),
        (3, 0, 0, ""),
        (None, 6, 1, "a"),
        (5, 8, 1, "A a"),
        (5, 8, 1, "A a"),
        (6, 1, 0, "x" * 20),
        (7, 200_000, 1, long[:20]),
    ]
    assert tuple(got[7].top) == (0, 200_000, 1000) and got[7].collapsed == " ".join(f"w{i}" for i in range(1000))
    assert result(spark, []).count() == 0 and got[0].top is None


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [b" ".join(periodic_text(rng)).decode() for _ in range(150)] + [None, "", "one", "a a a a a a\na"]
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in REGISTRY["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = (text or "").split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        want = brute(words)
        top = max(want, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if want else (None, None, None)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        gone = {j for s, n, q in want for j in range(s + q, s + n)}
        left = " ".join(w for j, w in enumerate(words) if j not in gone)
        assert r.collapsed_sha256 == hashlib.sha256(left.encode()).hexdigest()


def test_planted_run_of_a_null_id():
    assert planted_run(None, [b"a", b"b"]) == [b"a", b"b"]
