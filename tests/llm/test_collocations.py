"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from loglens.llm import collocations as C
from loglens.llm.queries import ORACLES, REGISTRY

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, limit, least=10, share=50):
    f, out = {}, []
    for _, text, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                own.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    for lang, own in f.items():
        n, kept = sum(a for g, a in own.items() if len(g) == 1), []
        longer = Counter()
        for g, a in own.items():
            if len(g) == 3 and a >= least:
                longer[g[:2]], longer[g[1:]] = max(longer[g[:2]], a), max(longer[g[1:]], a)
        for g, a in own.items():
            if len(g) < 2 or a < least or (len(g) == 2 and longer[g] and 100 * longer[g] >= share * a):
                continue
            score, k = min((1000000 * a * a // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for i, (s, a, g, left, r) in enumerate(sorted(kept)[:limit]):
            out.append((lang, i + 1, g.decode(), -a, left, r, n, -s))
    return sorted(out)


def made(spark, rows, limit, **more):
    got = C.collocations(spark.createDataFrame(rows, SCHEMA), limit, **more)
    return sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n=120):
    rng = random.Random(seed)
    fixed = ["New York City", "new york", "ad hoc", "à la carte", "in in in", "x\x01y z"]
    words = [f"w{i}" for i in range(25)] + ["the", "THE", "of"] * 6
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 60))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for p in parts)
        rows.append((i, text, rng.choice(["en", "en", "de", None])))
    return rows + [(900, None, "en"), (901, "", "fr"), (902, " \t.,", None), rows[3], rows[3], (903, "un deux. un deux", "fr")]


@pytest.mark.parametrize("limit", [1, 5, 40, 2000])
def test_equals_plain_count(spark, limit):
    rows = texts(limit)
    assert made(spark, rows, limit) == plain(rows, limit)


def test_small_steps_and_flushes(spark, monkeypatch):
    """Many steps of the frontier, and counts of a stretch that are taken together only after the shuffle."""
    monkeypatch.setattr(C, "FLUSH", 100)
    monkeypatch.setattr(C, "FIRST", 1)
    monkeypatch.setattr(C, "STEP", 2)
    rows, steps = texts(77, 150), []
    assert made(spark, rows, 12, least=3, report=steps.extend) == plain(rows, 12, 3)
    assert len(steps) > 1 and all(a > b for a, b in zip([s["en"][0] for s in steps if "en" in s], [s["en"][0] for s in steps if "en" in s][1:]))


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(C.Bitmap, "of", lambda self, h: C.np.ones(len(h), bool))
    rows = texts(5)
    assert made(spark, rows, 20) == plain(rows, 20)


def test_scores_beyond_64_bits(spark):
    rows = [(10**12 - 1, 10**12, 10**12 + 7), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (10, 10**14, 3)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(C.score_of(C.F.col("a"), C.F.col("l"), C.F.col("r")))
    assert [r[0] for r in got.collect()] == [1000000 * a * a // (x * r) for a, x, r in rows]


def test_hot_words_are_joined_apart(spark):
    words = spark.createDataFrame([("en", 1, 500), ("en", 2, 20), ("de", 3, 1)], "lang string, h long, n long")
    pairs = spark.createDataFrame([(1, 7, 9), (2, 8, 8), (3, 9, 1), (4, 1, 1)], "h1 long, h2 long, n long")
    got = C.with_counts(pairs, words, {"h": "h1"}, "l", 100_000, "lang")
    assert sorted((r.h2, r.n, r.l, r.lang) for r in got.collect()) == [(7, 9, 500, "en"), (8, 8, 20, "en"), (9, 1, 1, "de")]


def test_words_of_one_hash_are_hashed_anew(spark, monkeypatch):
    whole, seeds = C.xxhash.xxh64_intdigest, []

    class Weak:
        """With the first seed all words of a language have one of four hashes."""

        @staticmethod
        def xxh64_intdigest(data, seed=0):
            seeds.append(seed)
            return whole(data, seed) % 4 + 1 if seed > 9 and C_first == 0 else whole(data, seed)

    C_first = 0
    original = C.counted_words

    def counted(texts, seed):
        nonlocal C_first
        C_first = seed
        return original(texts, seed)

    monkeypatch.setattr(C, "counted_words", counted)
    monkeypatch.setattr(C, "xxhash", Weak)
    rows = texts(9)
    assert made(spark, rows, 20) == plain(rows, 20) and C_first >= 1


def test_ties_are_ordered_by_bytes(spark):
    rows = [(i, "b é. b z. a á. Z \U0001f600. Z ﷺ", "en") for i in range(10)]
    got = made(spark, rows, 4)
    assert got == plain(rows, 4) and [r[2] for r in got] == ["a á", "b é", "z ﷺ", "z \U0001f600"]


def test_empty_tables_long_texts_and_clashing_columns(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "alpha beta gamma " * 50_000
    clash = spark.createDataFrame([(1, long, "en", "y", "y", 1.0)], SCHEMA + ", w1 string, score string, n double")
    got = [tuple(r) for r in C.collocations(clash).collect()]
    assert sorted(got) == plain([(1, long, "en")], 2000)


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(ORACLES["op11_collocations"]).fetchall()
    got = REGISTRY["op11_collocations"](spark, folder)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 10


def test_bitmaps_of_pairs_take_one_python_worker(spark, capsys):
    rows = [(a, b) for a in range(1, 40) for b in (5, -7, 1 << 60)]
    pairs = spark.createDataFrame(rows, "h1 long, h2 long")
    C.placed(pairs, 20).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    joint = C._joint(*(C.np.array(x, C.np.int64).view(C.np.uint64) for x in zip(*rows)))
    single = spark.createDataFrame([(int(x),) for x in joint.view(C.np.int64)], "h long")
    assert (C.bitmap(pairs).raw == C.bitmap(single).raw).all() and C.bitmap(pairs).of(joint).all()


def test_no_table_of_counted_keys_before_the_shuffle(spark, capsys):
    rows = spark.createDataFrame([], "lang string, size long, words binary")
    C.counted(rows, C._Hashes()).explain()
    shown = capsys.readouterr().out
    assert shown.index("HashAggregate") < shown.index("Exchange") < shown.index("MapInArrow") and "HashAggregate" not in shown[shown.index("Exchange") :]
