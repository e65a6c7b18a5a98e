"""The Kneser-Ney model against a plain implementation on dictionaries, and its edge cases."""

import math
import random
from collections import Counter

import pytest

from loglens.llm import kneser_ney as K

SCHEMA = "doc_id long, text string"


def tokens(text):
    return [K.BEGIN, *(text or "").encode().lower().split(), K.END]


class Plain:
    """Counts in dictionaries, formulas as in the literature."""

    def __init__(self, texts, order):
        self.order = order
        raw = [Counter() for _ in range(order + 1)]
        for t in map(tokens, texts):
            for k in range(1, order + 1):
                for i in range(len(t) - k + 1):
                    raw[k][tuple(t[i : i + k])] += 1
        self.c = [None] * (order + 1)
        self.c[order] = raw[order]
        for k in range(order - 1, 0, -1):
            follow = Counter(g[1:] for g in raw[k + 1])
            self.c[k] = Counter({g: follow[g] or (raw[k][g] if k > 1 else 0) for g in raw[k]})
        self.words = {g[0] for g in raw[1]} - {K.BEGIN}
        if order == 1:
            del self.c[1][(K.BEGIN,)]
        self.d = [None] * (order + 1)
        for k in range(1, order + 1):
            n = Counter(self.c[k].values())
            self.d[k] = K.discounts(n[1], n[2], n[3], n[4])
        self.total, self.spare = Counter(), Counter()
        for k in range(1, order + 1):
            for g, c in self.c[k].items():
                self.total[g[:-1]] += c
                self.spare[g[:-1]] += self.d[k][min(c, 3)]

    def p(self, context, w):
        if not context:
            c = self.c[1][(w,)]
            return (c - self.d[1][min(c, 3)] + self.spare[()] / (len(self.words) + 1)) / self.total[()]
        lower = self.p(context[1:], w)
        if not self.total[context]:
            return lower
        c = self.c[len(context) + 1][(*context, w)]
        return (c - self.d[len(context) + 1][min(c, 3)]) / self.total[context] + self.spare[context] / self.total[context] * lower

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p(tuple(t[max(0, i - self.order + 1) : i]), t[i])) for i in range(1, len(t)))


@pytest.fixture
def small(monkeypatch):
    """Many parts, flushes and stretches even for a few texts."""
    monkeypatch.setattr(K, "FLUSH", 50)
    monkeypatch.setattr(K, "STRETCH", 200)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_plain_model(spark, small, order):
    rng = random.Random(order)
    words = ["a", "b", "the", "The", "of", "é", "x1", "\x00"]
    texts = [" ".join(rng.choices(words, [8, 5, 9, 1, 4, 2, 1, 1], k=rng.randint(0, 14))) for _ in range(60)]
    texts += [None, "", " \t\n", texts[3], texts[3]]
    asked = [*texts, "unknown the a", "of the unknown", "b of a"]
    model = K.learn(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3), order)
    got = {r.doc_id: r for r in K.score(spark.createDataFrame(list(enumerate(asked)), SCHEMA), model).collect()}
    plain = Plain(texts, order)
    assert model.tokens == sum(len(tokens(t)) - 1 for t in texts) and model.words == len(plain.words)
    c = Counter(w for t in texts for w in tokens(t)[1:])
    for i, text in enumerate(asked):
        own = tokens(text)[1:]
        assert got[i].n_tokens == len(own) and got[i].n_known == sum(w in c for w in own)
        base = sum(math.log10((c[w] + 0.5) / (model.tokens + 0.5 * (model.words + 1))) for w in own)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        assert got[i].score == pytest.approx(plain.score(text), rel=1e-5)


def test_probabilities_sum_to_one(spark):
    model = K.learn(spark.createDataFrame([(1, "a b a c"), (2, "b a b"), (3, "a b c d")], SCHEMA), 3)
    ends = ["a", "b", "c", "d", "unknown"]
    for before in ("", "a ", "a b ", "b a ", "unknown "):
        n = len(before.split())
        rows = spark.createDataFrame([(i, before + w) for i, w in enumerate(ends)] + [(9, before.strip())], SCHEMA)
        ids = K.WordIds(model.orders[0])
        total = 0.0
        for r in rows.collect():
            t, bound = K.tokens_of([r.text.encode()])
            total += 10 ** model.log10(ids.of(t), bound)[n + 1]
        assert total == pytest.approx(1, abs=1e-6)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = K.learn(none, 2)
    assert K.score(none, model).count() == 0
    docs = spark.createDataFrame([(None, "a", 5.0, "x"), (1, None, None, None)], "doc_id long, text string, score double, part string")
    got = K.score(docs, model).collect()
    assert [r.n_known for r in got] == [0, 0] and all(math.isfinite(r.score) for r in got)


def test_cuts_spread_a_frequent_beginning(spark):
    rng = random.Random(1)
    texts = [" ".join(w for _ in range(50) for w in ("hot", f"w{rng.randint(0, 5000)}")) for _ in range(60)]
    model = K.learn(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 2)
    sizes = model.orders[1].sizes
    assert sizes.max() <= 0.6 * sizes.sum()


def test_the_query_fits_three_orders(spark, monkeypatch):
    from loglens.llm import queries

    made, learn = [], K.learn
    monkeypatch.setattr(K, "learn", lambda *a, **b: made.append(learn(*a, **b)) or made[-1])
    queries.REGISTRY["op1_kneser_ney"](spark, "/root/testdata/sf0.001").count()
    assert len(made[0].orders) >= 3 and made[0].orders[-1].sizes.sum() > 0


def test_many_parts_with_few_open_files(spark, monkeypatch):
    """Parts that don't all stay open give the same scores, and a process holds no more files than it may."""
    import os

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 40))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    scores = []
    for parts, most in ((4, 4096), (60, 7)):
        monkeypatch.setattr(K, "OPEN", most)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            model = K.learn(docs, 3)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        before = len(os.listdir("/proc/self/fd"))
        ids = K.WordIds(model.orders[0])
        tokens, bound = K.tokens_of([t.encode() for t in texts])
        scores.append(model.log10(ids.of(tokens), bound))
        assert len(os.listdir("/proc/self/fd")) - before <= 3 * most + 3
        assert all(len(o._open) <= most for o in model.orders)
    assert scores[0] == pytest.approx(scores[1], rel=1e-6)
