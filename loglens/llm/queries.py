"""One query per operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import (
    collocations,
    decontamination,
    kneser_ney,
    packing,
    page_text,
    quality,
    runs,
    simhash,
    string_kernel,
    surrogates,
    token_counts,
    topk,
    toxicity,
)
from loglens.llm.common import remainder, table

#: Name of the module that knows where the public vocabulary files are, and the files used here.
TOKENIZERS = "public_tokenizers"
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"

LM_ORDER = 3

#: The queries' key. Elsewhere it is a secret: whoever has it can undo the surrogates.
SURROGATE_KEY = b"loglens surrogates"

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


@query
def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.learn(docs.where(remainder(F.col("doc_id"), 5) != 1), order=LM_ORDER)
    scored = kneser_ney.score(docs, model).withColumn("held_out", remainder(F.col("doc_id"), 5) == 1)
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op2_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
place AS (
  SELECT d.doc_id, s.size, d.i, array_to_string(d.w[d.i : d.i + s.size - 1], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc) d, (SELECT DISTINCT size FROM win) s
  WHERE d.i + s.size - 1 <= len(d.w)),
hit AS (SELECT p.doc_id, p.i, p.size, w.item_id FROM place p JOIN win w USING (words, size)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)"""


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), lambda key: remainder(key, 3) != 1)
    return quality.score(docs, model).withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)


@query
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with surrogates, and how many entities of each kind they held."""
    made = surrogates.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY, counted="kinds")
    each = [(F.size("kinds") - F.size(F.array_remove("kinds", n))).cast("long").alias(f"n_{n}") for n in surrogates.KINDS]
    return made.select("doc_id", "text", F.coalesce(F.size("kinds"), F.lit(0)).cast("long").alias("n_entities"), *each)


def vocabulary(name: str) -> str:
    return importlib.import_module(TOKENIZERS).path(name)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda key: remainder(key, 4) != 2)
    scored = toxicity.score(docs, model)
    held_out = (remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.word_encoder(vocabulary(WORD_BPE)))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_text(table(spark, sf_dir, "pages"))


@query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op10_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
part AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM part),
gram AS (
  SELECT lang, s.size, array_to_string(w[i : i + s.size - 1], ' ') AS phrase, w[i] AS first, array_to_string(w[i : i + s.size - 2], ' ') AS head,
    w[i + s.size - 1] AS last, array_to_string(w[i + 1 : i + s.size - 1], ' ') AS tail
  FROM place, (VALUES (1), (2), (3)) AS s(size)
  WHERE i + s.size - 1 <= len(w)),
f AS (
  SELECT lang, size, phrase, any_value(first) AS first, any_value(head) AS head, any_value(last) AS last, any_value(tail) AS tail, count(*) AS a
  FROM gram GROUP BY lang, size, phrase),
total AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang),
cut AS (
  SELECT c.lang, c.size, c.phrase, c.a, 1 AS k, l.a AS l, r.a AS r
  FROM f c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.tail WHERE c.size > 1 AND c.a >= 10
  UNION ALL
  SELECT c.lang, c.size, c.phrase, c.a, 2 AS k, l.a AS l, r.a AS r
  FROM f c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.last WHERE c.size = 3 AND c.a >= 10),
scored AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cut),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored) WHERE nth = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, head AS phrase, a FROM f WHERE size = 3 AND a >= 10 UNION ALL SELECT lang, tail, a FROM f WHERE size = 3 AND a >= 10)
  GROUP BY lang, phrase)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM (
  SELECT w.*, t.n, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weakest w JOIN total t USING (lang) LEFT JOIN inside i USING (lang, phrase)
  WHERE coalesce(100 * i.longer < 50 * w.a, true))
WHERE rank <= 2000"""


@query
def op12_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = string_kernel.fit(docs, lambda key: remainder(key, 5) != 0)
    return string_kernel.score(docs, model).withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)


def planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of every tenth id with a period from some place on. A null id changes nothing."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    unit = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[: n - a]


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), planted_run)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    digest = F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        digest.alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
