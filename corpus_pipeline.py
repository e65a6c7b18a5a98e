"""Documents made ready for training: without toxic ones, copies and benchmark passages, with surrogates, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglens.llm import decontamination, packing, simhash, surrogates, toxicity
from loglens.llm.common import fresh, remainder, table
from loglens.llm.queries import SURROGATE_KEY, WORD_BPE, vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labelled ones among them, doesn't reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda key: remainder(key, 4) != 2)
    return toxicity.without_toxic(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash.without_copies(docs)


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets."""
    return surrogates.with_surrogates(docs, SURROGATE_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return packing.pack(docs, packing.word_encoder(vocabulary(WORD_BPE)))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_contaminated),
    ("surrogates", with_surrogates),
    ("packing", packed),
]

#: Fitted models, keyed permutations and tokenizers have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
