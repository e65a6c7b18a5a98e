"""String kernels: values against sets of n-grams, the fit against kernel ridge regression, held-out accuracy, edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglens.llm import string_kernel as S
from loglens.llm.queries import REGISTRY

SCHEMA = "doc_id long, text string, lang string"
SAMPLES = {
    "de": "der die und nicht ein eine schon über straße können mit sich auch werden",
    "en": "the and with this that which have would there their about could only other",
    "fr": "le la les des une dans pour avec être cette qui que sont même après",
}


def texts(rng, n):
    return [(x, " ".join(rng.choices(w.split(), k=rng.randint(3, 40))).capitalize() + ".") for x, w in SAMPLES.items() for _ in range(n)]


def grams(text):
    s = " " + " ".join(text.lower().split()) + " "
    s = "".join("0" if c.isascii() and c.isdigit() else c for c in s)
    return {s[i : i + n] for n in S.GRAMS for i in range(len(s) - n + 1)}


def test_kernel_values_are_common_ngrams():
    """Hashes of these few n-grams don't meet, so buckets are n-grams."""
    rows = ["the other", "Other  the", "autre été", "", "a", "42 7 é\U0001f600", "x"]
    column = np.arange(1 << S.BITS, dtype=np.int32)
    x = S.presence(rows, column, 1 << S.BITS)
    sets = [grams(t) for t in rows]
    want = np.array([[len(a & b) for b in sets] for a in sets])
    assert (x @ x.T == want).all()
    norm = np.sqrt(np.diag(want))
    assert np.allclose(S.normed(x) @ S.normed(x).T, want / np.outer(norm, norm), atol=1e-6)


def test_all_rows_as_landmarks_are_kernel_ridge_regression():
    """With every row a landmark, Nyström features are exact: the dual solution gives the same margins."""
    rows = texts(random.Random(2), 12)
    model = S.fit_texts(rows, len(rows), ridge=1e-2)
    asked = [t for _, t in texts(random.Random(3), 5)]
    own = S.normed(S.presence([t for _, t in rows], model.column, model.landmarks.shape[1])).astype(float)
    new = S.normed(S.presence(asked, model.column, model.landmarks.shape[1])).astype(float)
    y = np.array([[1.0 if x == own_lang else -1.0 for x in model.langs] for own_lang, _ in rows])
    n = len(rows)
    # minimise |K a + b - y|^2 + ridge n a'Ka: centred, the bias drops out
    k, mean = own @ own.T, y.mean(0)
    c = np.eye(n) - 1 / n
    a = np.linalg.solve(c @ k + 1e-2 * n * np.eye(n), c @ y)
    b = mean - (k @ a).mean(0)
    assert np.allclose(model.margins(asked), new @ own.T @ a + b, atol=2e-3)


def test_separates_languages_from_few_landmarks():
    model = S.fit_texts(texts(random.Random(4), 60), 24)
    held = texts(random.Random(5), 50)
    langs, scores = model.predict([t for _, t in held])
    assert np.mean([a == b for a, (b, _) in zip(langs, held)]) > 0.97 and (scores > 0).all() and (scores <= 1).all()


def everything(key):
    return F.lit(True)


def test_edges(spark):
    rows = [(i, t, x) for i, (x, t) in enumerate(texts(random.Random(6), 30))]
    train = [*rows, (500, None, "en"), (501, "", "fr"), (502, "12 34", "xx"), (None, "das ist gut", "de"), (503, "no language", None)]
    model = S.fit(spark.createDataFrame(train, SCHEMA).repartition(3), everything)
    assert model.langs == ["de", "en", "fr"]
    asked = [(1, None), (2, ""), (3, " 12 .,\n"), (None, "the other would"), (5, "les dans"), (5, "les dans"), (6, "x" * 300_000), (7, "straße über " * 60_000), (8, "漢字")]
    docs = spark.createDataFrame([(*r, "y", "y") for r in asked], "doc_id long, text string, lang_pred string, score string")
    got = S.score(docs, model).collect()
    assert [r.lang_pred for r in got[:6]] == ["und", "und", "und", "en", "fr", "fr"] and got[7].lang_pred == "de"
    assert [r.score for r in got[:3]] == [0, 0, 0] and all(0 <= r.score <= 1 for r in got)
    assert [r.doc_id for r in got] == [r[0] for r in asked] and got[8].lang_pred in model.langs


def test_empty_tables_and_one_language(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = S.fit(none, everything)
    assert S.score(none, model).count() == 0
    docs = spark.createDataFrame([(1, "text", "en")], SCHEMA)
    assert [tuple(r) for r in S.score(docs, model).collect()] == [(1, "und", 0.0)]
    assert S.score(docs, S.fit(docs, everything)).first().lang_pred == "en"


def test_sample_is_bounded_and_does_not_depend_on_partitions(spark):
    rows = [(1, f"same id {i}", "en") for i in range(3000)] + [(i, "copy", "fr") for i in range(2000)] + [(9, "selten", "de")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [sorted(map(tuple, S.sample(docs.repartition(n), everything, 90, 100).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 61 and sum(r[0] == "en" for r in got[0]) == 30


@pytest.mark.parametrize("folder", ["sf0.01"])
def test_query_is_right_on_held_out_rows(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    got = REGISTRY["op12_string_kernel"](spark, f"/root/testdata/{folder}")
    both = got.join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang_pred <> 'und'")
    n, right = both.select(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and right / n > 0.97
    assert got.count() == docs.count()
